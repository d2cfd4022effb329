"""Personal numbers, dates, addresses and secrets replaced by format-preserving Feistel pseudonyms, in SQL functions only.

Every value is taken as a vector of small numbers, each with its own radix: characters of a
class, octets, or parts of a date. Rounds of a Feistel network add to one half of the vector
keyed hashes of the other half, modulo the radices. Each round can be undone, so the whole is
a permutation of the values of a format: equal values get equal pseudonyms in all documents,
different ones different pseudonyms, and only the key tells which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
#: Vectors beyond this length enter the hashes of a round as digests.
LONG = 64
#: Dates are permuted inside windows of 365 * 200 days that begin here, and inside what these leave of the years 1 to 9999 at both ends.
DATE_ORIGIN, DATE_RADICES, FIRST_RADICES, LAST_RADICES = "1900-01-01", (365, 200), (563, 65), (601, 64)
#: Windows before the origin and from it on, and days before the origin.
WINDOWS_BEFORE, WINDOWS_AFTER, DAYS_BEFORE = 9, 40, 693_595
#: Country calling codes of one and of two digits; all others have three.
CODES_1 = ("1", "7")
CODES_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")

#: Lengths of the IBANs of countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, names in IBAN_LENGTHS.items())
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: After a space, a value of another kind, which groups of digits before it do not take in.
_NEXT = rf"(?! (?:{_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])|[0-9]{{4}}([/-])[0-9]{{2}}[/-][0-9]{{2}}(?![0-9/-])|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}(?![0-9])|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-])|[2-9][0-9]{{2}}[.-][2-9][0-9]{{2}}[.-][0-9]{{4}}(?![0-9-])))".replace("([/-])", "[/-]")

#: A further digit of a telephone number; look-behinds take no repeated groups.
_MORE = "[ .()-]{0,3}[0-9]"

#: What may be a value, in the order in which alternatives are tried. Validation comes after; what fails it is searched again by ``WITHIN``.
CANDIDATES: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}+)++",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])|\b(?i:password|passwd|pwd|secret|api_key|apikey)[=:] ?(?=[A-Za-z_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9_-]{6,}",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9/-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9])\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![A-Za-z0-9])"
    + rf"|(?<![A-Za-z0-9])\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{1,4}}\)?(?:{_NEXT}[ .-]?[0-9]{{2,4}}){{2,4}}(?![A-Za-z0-9])(?<=\+[0-9]{_MORE * 7}{f'(?:{_MORE})?' * 7})"
    + r"|(?<![A-Za-z0-9])\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9.-])[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}(?![A-Za-z0-9-])",
    "card": rf"(?<![A-Za-z0-9.-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z]|-(?![0-9]))(?:{_NEXT}[ -][0-9]++(?![A-Za-z]|-(?![0-9])))*+",
}
#: Real groupings of card numbers, longest first. A run of groups that is no card number as a whole may hold some.
_CARDS = [r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{1,3}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{4}", r"[0-9]{6}([ -])[0-9]{13}", r"[0-9]{13,19}"]
#: Patterns of values inside a candidate that failed; the value is the first group, at any place, so that matches may overlap.
WITHIN = [*(rf"(?<![A-Za-z0-9.-])(?=({p})(?![A-Za-z0-9-]))" for p in _CARDS), *(f"(?=({CANDIDATES[k]}))" for k in ("iban", "date", "ssn", "ip", "phone", "secret"))]
PATTERN = "|".join(f"(?:{p})" for p in CANDIDATES.values())
#: No candidate is without one of these characters.
HINT = "[0-9@=:]"

#: How a date begins, and its format. The last one holds for dates that the one before cannot have, days from 13 on.
_DATE_FORMATS = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\\.", "dd.MM.yyyy"), ("^[0-9]{2}/(?:0[1-9]|1[0-2])/", "dd/MM/yyyy"), ("^[0-9]{2}/(?:1[3-9]|[23][0-9])/", "MM/dd/yyyy"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(values: str, radices: str, tweak: str, key: str) -> str:
    """SQL: the permuted vector. ``values`` and ``radices`` are arrays of bigint of one length.

    A hash reads the tweak and the other half of the vector, or their digests where the vector is long: the time is linear in its length.
    """
    short = lambda text: _let("part", text, f"if(size(v) > {LONG}, sha2(part, 256), part)")
    half = "array_join(if(i % 2 = 1, slice(acc, h + 1, size(acc)), slice(acc, 1, h)), ',')"
    shift = f"cast(conv(substr(sha2(concat_ws('|', {key}, tw, i, j, other), 256), 1, 12), 16, 10) as bigint)"
    turn = _let("other", short(half), f"transform(acc, (x, j) -> if((i % 2 = 1) = (j < h), pmod(x + {shift}, rx[j]), x))")
    rounds = f"aggregate(sequence(1, {ROUNDS}), v, (acc, i) -> {turn})"
    return _let("v", values, _let("rx", radices, _let("h", "cast(size(v) div 2 as int)", _let("tw", short(tweak), rounds))))


def _characters(text: str, kinds: str, tweak: str, key: str) -> str:
    """SQL: characters of ``text`` permuted, each inside the class that ``kinds`` names at its place.

    Classes: d digit, n digit from 2, h letter a to f, g letter A to F, l letter a to z, u letter A to Z, anything else stays.
    """
    radix = "case k when 'd' then 10L when 'n' then 8L when 'h' then 6L when 'g' then 6L when 'l' then 26L when 'u' then 26L else 1L end"
    base = "case k when 'd' then 48 when 'n' then 50 when 'h' then 97 when 'g' then 65 when 'l' then 97 when 'u' then 65 else ascii(c) end"
    values = f"zip_with(cs, ks, (c, k) -> cast(ascii(c) - ({base}) as bigint))"
    new = _feistel(values, f"transform(ks, k -> {radix})", f"concat({tweak}, ':', ksn)", key)
    join = f"array_join(zip_with(zip_with(cs, ks, (c, k) -> struct(c as c, k as k, ({base}) as b)), p, (s, w) -> if(instr('dnhglu', s.k) = 0, s.c, chr(s.b + w))), '')"
    return _let("ksn", kinds, _let("cs", f"split({text}, '')", _let("ks", "split(ksn, '')", _let("p", new, join))))


def _classes(text: str, letters: str = "l", capitals: str = "u") -> str:
    """SQL: the class of every character of an ASCII text, letters and digits by their kind."""
    return f"translate(regexp_replace(regexp_replace(regexp_replace({text}, '[A-Z]', 'U'), '[a-z]', '{letters}'), '[0-9]', 'd'), 'U', '{capitals}')"


def _luhn(digits: str) -> str:
    """SQL: sum of the digits with every second one from the right doubled, modulo 10; 0 is valid."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, n) -> if(n % 2 = 1, if(int(c) > 4, int(c) * 2 - 9, int(c) * 2), int(c))), 0, (s, x) -> s + x) % 10"


def _mod97(text: str) -> str:
    """SQL: remainder by 97 of digits and letters, A being 10."""
    return f"aggregate(split({text}, ''), 0L, (s, c) -> if(c between '0' and '9', (s * 10 + int(c)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _email(key: str) -> str:
    local = "substr(m, 1, instr(m, '@') - 1)"
    return f"concat({_characters(local, _classes(local), _quoted('email'), key)}, substr(m, instr(m, '@')))"


def _secret(key: str) -> str:
    aws = f"concat('AKIA', {_characters('substr(m, 5)', _classes('substr(m, 5)'), _quoted('aws'), key)})"
    hexes = _characters("m", _classes("m", "h", "g"), _quoted("hex"), key)
    name = "regexp_extract(m, '^[A-Za-z_]+[=:] ?', 0)"
    value = f"substr(m, length({name}) + 1)"
    word = f"concat({name}, {_characters(value, _classes(value), _quoted('word'), key)})"
    return f"case when m rlike '^AKIA[0-9A-Z]{{16}}$' then {aws} when m rlike '^([0-9a-f]+|[0-9A-F]+)$' then {hexes} else {word} end"


def _filled(new: str, kept: str) -> str:
    """SQL: m with its characters of the class ``kept`` replaced in order by those of ``new``; separators stay, so that one value written in several ways stays one."""
    rank = f"length(regexp_replace(substr(m, 1, i + 1), '[^{kept}]', ''))"
    return f"array_join(transform(split(m, ''), (c, i) -> if(c rlike '[{kept}]', substr({new}, {rank}, 1), c)), '')"


def _iban(key: str) -> str:
    body = "substr(replace(m, ' ', ''), 5)"
    check = f"lpad(cast(98 - {_mod97("concat(nb, substr(m, 1, 2), '00')")} as string), 2, '0')"
    new = _let("nb", _characters(body, _classes(body), "concat('iban', substr(m, 1, 2))", key), f"concat(substr(m, 1, 2), {check}, nb)")
    return _let("nn", new, _filled("nn", "0-9A-Z"))


def _date(key: str) -> str:
    """A date of the same window; a date that only the last format can have becomes one of these, by permuting again until it is."""
    days = DATE_RADICES[0] * DATE_RADICES[1]
    first, last = -WINDOWS_BEFORE * days, WINDOWS_AFTER * days
    where = f"named_struct('begin', case when n < {first} then -{DAYS_BEFORE}L when n >= {last} then {last}L else cast(floor(n / {days}) as bigint) * {days} end, 'a', case when n < {first} then {FIRST_RADICES[0]}L when n >= {last} then {LAST_RADICES[0]}L else {DATE_RADICES[0]}L end, 'b', case when n < {first} then {FIRST_RADICES[1]}L when n >= {last} then {LAST_RADICES[1]}L else {DATE_RADICES[1]}L end)"
    permuted = _let("w", where, _let("q", _feistel("array(cast((n - w.begin) % w.a as bigint), cast((n - w.begin) div w.a as bigint))", "array(w.a, w.b)", _quoted("date"), key), "w.begin + q[0] + q[1] * w.a"))
    out = "cast(null as string)"
    for start, pattern in reversed(_DATE_FORMATS):
        again = f"aggregate(sequence(1, 99), cast(null as bigint), (got, turn) -> if(got is not null and day(date_add(date'{DATE_ORIGIN}', cast(got as int))) > 12, got, {_let('n', 'coalesce(got, n0)', permuted)}))"
        new = again if pattern == "MM/dd/yyyy" else _let("n", "n0", permuted)
        back = _let("n0", f"cast(datediff(try_to_date(m, '{pattern}'), date'{DATE_ORIGIN}') as bigint)", f"date_format(date_add(date'{DATE_ORIGIN}', cast({new} as int)), '{pattern}')")
        out = f"case when m rlike '{start}' then {back} else {out} end"
    return out


def _ssn(key: str) -> str:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area = "int(substr(m, 1, 3))"
    values = f"array(cast({area} - 1 - if({area} > 666, 1, 0) as bigint), cast(int(substr(m, 5, 2)) - 1 as bigint), cast(int(substr(m, 8, 4)) - 1 as bigint))"
    text = "concat(lpad(cast(q[0] + 1 + if(q[0] + 1 >= 666, 1, 0) as string), 3, '0'), '-', lpad(cast(q[1] + 1 as string), 2, '0'), '-', lpad(cast(q[2] + 1 as string), 4, '0'))"
    return _let("q", _feistel(values, "array(898L, 99L, 9999L)", _quoted("ssn"), key), text)


def _ip(key: str) -> str:
    return f"array_join({_feistel("transform(split(m, '[.]'), c -> cast(c as bigint))", 'array(256L, 256L, 256L, 256L)', _quoted('ip'), key)}, '.')"


def _phone(key: str) -> str:
    """Ten digits, after +1 or nothing, keep their shape (area and exchange from 2 on); other numbers keep their country code, which does not depend on how a number is written."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    ten = f"(m like '+1%' and length({digits}) = 11 or not m like '+%' and length({digits}) = 10) and right({digits}, 10) rlike '^[2-9][0-9]{{2}}[2-9]'"
    code = f"(case when left({digits}, 1) in {CODES_1} then 1 when left({digits}, 2) in {CODES_2} then 2 else 3 end)"
    american = f"concat(if(length({digits}) = 11, '1', ''), {_characters(f'right({digits}, 10)', _quoted('nddndddddd'), _quoted('ten'), key)})"
    rest = f"substr({digits}, {code} + 1)"
    other = f"concat(left({digits}, {code}), {_characters(rest, f"repeat('d', length({rest}))", f'left({digits}, {code})', key)})"
    return _let("nn", f"if({ten}, {american}, {other})", _filled("nn", "0-9"))


def _card(key: str) -> str:
    """The first digit stays, the last one is the check digit of the new number."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    inner = f"substr({digits}, 2, length({digits}) - 2)"
    new = f"concat(left({digits}, 1), {_characters(inner, f"repeat('d', length({inner}))", f"concat('card', left({digits}, 1))", key)})"
    luhn = _luhn("concat(nc, '0')")
    return _let("nc", new, _let("nn", f"concat(nc, cast((10 - {luhn}) % 10 as string))", _filled("nn", "0-9")))


def _valid() -> dict[str, str]:
    """SQL tests of a candidate m, in the order in which they decide its kind."""
    dates = " or ".join(f"(m rlike '{start}' and try_to_date(m, '{pattern}') is not null)" for start, pattern in _DATE_FORMATS)
    digits = "regexp_replace(m, '[^0-9]', '')"
    whole = lambda kind: f"m rlike {_quoted('^(?:' + CANDIDATES[kind] + ')$')}"
    return {
        "email": "instr(m, '@') > 0",
        "iban": f"{whole('iban')} and {_mod97("concat(substr(replace(m, ' ', ''), 5), substr(m, 1, 4))")} = 1",
        "date": f"{whole('date')} and ({dates})",
        "ssn": f"{whole('ssn')} and not (substr(m, 1, 3) in ('000', '666') or substr(m, 1, 1) = '9' or substr(m, 5, 2) = '00' or substr(m, 8) = '0000')",
        "ip": f"{whole('ip')} and forall(split(m, '[.]'), c -> int(c) <= 255)",
        "phone": f"{whole('phone')} and length({digits}) between 8 and 15",
        "card": f"{whole('card')} and length({digits}) between 13 and 19 and {_luhn(digits)} = 0",
        "secret": f"{whole('secret')} and not m rlike '^[0-9 -]{{13,19}}$'",
    }


def findings(text: Column, key: str) -> tuple[Column, str]:
    """The candidates of a text in order, and SQL that makes of each: its new text, and what was found (value, kind and pseudonym; kind is null if nothing is valid).

    A candidate that fails is searched again for valid values inside it.
    """
    secret = _quoted(key)
    kind = "case " + " ".join(f"when {test} then '{name}'" for name, test in _valid().items()) + " end"
    makers = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}
    pseudonym = "case k0 " + " ".join(f"when '{name}' then {maker(secret)}" for name, maker in makers.items()) + " else m end"
    one = _let("k0", kind, f"struct(m as value, k0 as kind, {pseudonym} as pseudonym)")
    whole = "struct(a.pseudonym as text, array(a) as found)"
    inside = ", ".join(f"regexp_extract_all(o, {_quoted(p)}, 1)" for p in WITHIN)
    values = f"filter(array_distinct(flatten(array({inside}))), m -> ({kind}) is not null)"
    literal = "concat('(?<![A-Za-z0-9])(?:', array_join(transform(vs, x -> concat('\\\\Q', x, '\\\\E')), '|'), ')(?![A-Za-z0-9])')"
    parts = f"transform(regexp_extract_all(o, lit, 0), m -> {one})"
    joined = "array_join(flatten(zip_with(split(o, lit, -1), ps, (x, y) -> array(x, coalesce(y.pseudonym, '')))), '')"
    again = _let("lit", literal, _let("ps", parts, f"struct({joined} as text, ps as found)"))
    retried = _let("vs", values, f"if(size(vs) = 0, {whole}, {again})")
    each = _let("a", _let("m", "o", one), f"if(a.kind is not null or length(o) < 9, {whole}, {retried})")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, f"transform(candidates, o -> {each})"


def _replaced(docs: DataFrame, key: str, candidates: str, results: str) -> DataFrame:
    """``docs`` with its texts replaced, and two helper columns."""
    found, each = findings(F.col("text"), key)
    rows = docs.withColumn(candidates, F.coalesce(found, F.array().cast("array<string>"))).withColumn(results, F.expr(each.replace("transform(candidates,", f"transform(`{candidates}`,", 1)))
    pieces = F.split("text", PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.transform(results, lambda f: f["text"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return rows.withColumn("text", F.when(F.size(candidates) > 0, whole).otherwise(F.col("text")))


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with personal values in ``text`` replaced, and ``findings``: array of (value, kind, pseudonym).

    Kinds: e-mail addresses (local part), keys and passwords, IBANs (with valid check digits),
    calendar dates, social security numbers, IPv4 addresses, telephone numbers and payment card
    numbers (with a valid check digit, which the pseudonym has too). What fails its kind's
    validation stays as it is, but for valid values inside it. One pass over the rows, no shuffle and no Python.
    ``findings`` has the original values: it is for those who may see both, and ``with_pseudonyms``
    returns none of it.

    Cases: a null text stays null and has no findings, an empty one stays empty; a column
    ``findings`` is replaced, any other stays, whatever its name; rows that repeat get equal results;
    an empty table gives no rows; values and texts of any length are read and replaced whole, in
    time that is linear in a value's length and without recursion in patterns. n_chars, where there is such a column, is the caller's to renew.
    """
    candidates, results = free_name(docs, "pii_candidates"), free_name(docs, "pii_results")
    rows = _replaced(docs, key, candidates, results)
    found = F.filter(F.flatten(F.transform(results, lambda f: f["found"])), lambda f: f["kind"].isNotNull())
    return rows.withColumn("findings", found).drop(candidates, results)


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """The rows and columns of ``docs``, personal values in ``text`` replaced as ``pseudonymized`` does it, and nothing else changed or added.

    Cases: as there; columns named ``findings`` or like helper columns stay as they are.
    """
    return _replaced(docs, key, free_name(docs, "pii_candidates"), free_name(docs, "pii_results")).select(*[f"`{c}`" for c in docs.columns])
