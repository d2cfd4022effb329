"""Protocols and plans: rows brought to one form, signed manifests, fingerprints of file trees, sampling plans, exact correspondence."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import canonical_status
from .order import dealt


def canonical_sha256(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def coerced(rows: DataFrame) -> DataFrame:
    """Result rows in one form: aliases resolved, truth lower-cased, prediction upper-cased, defaults filled, error type from the status.

    ``truth`` falls back to ``ground_truth_label``; a missing status is a failure; missing ids and
    datasets are unknown; durations hold a total where only that was given.
    """
    status = F.coalesce(F.nullif(canonical_status(F.col("status")), F.lit("")), F.lit("failure"))
    return rows.select(
        F.coalesce(F.nullif("case_id", F.lit("")), F.lit("unknown")).alias("case_id"),
        F.coalesce(F.nullif("dataset", F.lit("")), F.lit("unknown")).alias("dataset"),
        F.lower(F.coalesce(F.nullif("truth", F.lit("")), "ground_truth_label")).alias("truth"),
        F.upper(F.nullif("prediction", F.lit(""))).alias("prediction"),
        status.alias("status"),
        F.when(status.isin("failure", "timeout", "invalid_response"), F.upper(status)).alias("error_type"),
        F.when(F.col("duration_seconds").isNotNull(), F.create_map(F.lit("total"), F.col("duration_seconds"))).otherwise(F.create_map().cast("map<string,double>")).alias("durations"),
    )


def attach_truth(inferred: DataFrame, labels: DataFrame, key: str = "case_id") -> DataFrame:
    """Labels joined after inference; correct is null where no decision was made. Inferred rows must not have the label."""
    if "truth" in inferred.columns:
        raise ValueError("inferred rows already name a truth")
    out = inferred.join(labels.select(key, "truth"), key, "left")
    said = F.when(F.col("prediction") == "POSITIVA", "positive").when(F.col("prediction") == "NEGATIVA", "negative")
    return out.withColumn("correct", said == F.col("truth"))


def corresponding(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``right`` whose composite key ``left`` has."""
    return right.join(left.select(*keys).distinct(), list(keys), "left_semi")


def correspondence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys are on both sides, on the left or on the right only; exact correspondence needs one line, both."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "both").when(F.col("__l").isNotNull(), "left").otherwise("right")
    return a.join(b, list(keys), "full").groupBy(side.alias("side")).agg(F.count("*").alias("keys"))


def frozen(cases: DataFrame, splits: DataFrame, settings: Mapping[str, object]) -> dict:
    """A signed protocol: counts of labels and datasets, a fingerprint of the splits, and the settings. Counts are all that comes to the driver."""
    counts = lambda c: {str(r[c]): r["n"] for r in cases.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()}
    body = {"cases": cases.count(), "labels": counts("label"), "datasets": counts("dataset_id"), "splits_sha256": rows_fingerprint(splits), "settings": dict(settings), "settings_sha256": canonical_sha256(dict(settings))}
    return {**body, "signature": canonical_sha256(body)}


def verified(protocol: Mapping[str, object], cases: DataFrame, splits: DataFrame, settings: Mapping[str, object]) -> list[str]:
    """What of a frozen protocol no longer holds; nothing if it does."""
    body = {k: v for k, v in protocol.items() if k != "signature"}
    problems = [] if canonical_sha256(body) == protocol.get("signature") else ["signature"]
    now = frozen(cases, splits, settings)
    return problems + [k for k in ("cases", "labels", "datasets", "splits_sha256", "settings_sha256") if now[k] != protocol.get(k)]


def rows_fingerprint(rows: DataFrame) -> str:
    """A hash of a table's rows whatever their order: hashes are added up as numbers of four parts, so nothing is sorted or collected."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(rows.columns)])), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"p{k}") for k in range(5)]
    row = rows.agg(F.count("*").alias("n"), *parts).first()
    return canonical_sha256([str(x) for x in row])


def tree_fingerprints(files: DataFrame, by: str = "root") -> DataFrame:
    """(root, files, bytes, sha256) over lines of path, zero byte, size, zero byte and content hash in order of path."""
    line = F.concat(F.col("relative"), F.lit("\u0000"), F.col("length").cast("string"), F.lit("\u0000"), F.col("sha256"), F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("relative", line.alias("l")))), lambda s: s["l"])
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(lines, ""), 256).alias("sha256"))


def sampling_plan(backgrounds: DataFrame, donors: DataFrame, targets: Mapping[str, int], seed: int) -> DataFrame:
    """One row for each planned case: label, background and donor, each used again only when all of its kind have been used.

    Orders are by hashes of the seed, so that the plan can be repeated anywhere. ``backgrounds``
    has case_id, ``donors`` case_id and label; labels without donors have none.
    """
    spark = backgrounds.sparkSession
    hashed = lambda *c: F.sha2(F.concat_ws("|", F.lit(str(seed)), *c), 256)
    wanted = spark.createDataFrame(list(targets.items()), "label string, n int").where("n > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    wanted = wanted.withColumn("__key", F.concat_ws("|", "label", F.col("turn").cast("string")))
    planned = dealt(wanted, [], hashed(F.col("label"), F.col("turn").cast("string")), "__key", "index").withColumn("index", F.col("index") + 1).drop("__key")
    pool = dealt(backgrounds.select(F.col("case_id").alias("background_case_id")), [], hashed(F.col("background_case_id")), "background_case_id", "place")
    total = pool.count()
    given = planned.withColumn("place", (F.col("index") - 1) % total).join(pool, "place").withColumn("background_variant", F.floor((F.col("index") - 1) / total).cast("int") + 1)
    kinds = dealt(donors, ["label"], hashed(F.col("label"), F.col("case_id")), "case_id", "d")
    sizes = donors.groupBy("label").agg(F.count("*").alias("k"))
    out = given.join(sizes, "label", "left").withColumn("d", F.col("turn") % F.col("k")).join(kinds.select("label", "d", F.col("case_id").alias("donor_case_id")), ["label", "d"], "left")
    return out.select(F.format_string("planned-%04d", "index").alias("case_id"), "label", "background_case_id", "background_variant", "donor_case_id")


def best_candidates(candidates: DataFrame, by: str = "case_id", score: str = "log_odds", number: str = "candidate") -> DataFrame:
    """Each case's candidate with the highest score; equal scores: the lowest number."""
    return candidates.groupBy(by).agg(F.max(score).alias(score), F.max_by(number, F.struct(score, (-F.col(number)).alias("o"))).alias(number))


def alignment_choice(rows: DataFrame, least: float) -> DataFrame:
    """Adds method and selected_dice: pairwise only if it is better than identity; accepted says whether the better one reaches ``least``."""
    better = F.col("pairwise_dice") > F.col("identity_dice")
    out = rows.withColumns({"method": F.when(better, "pairwise").otherwise("identity"), "selected_dice": F.greatest("identity_dice", "pairwise_dice")})
    return out.withColumn("accepted", F.col("selected_dice") >= least)


def mask_union(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Points of either mask and which masks have them."""
    a, b = first.select(*keys).distinct().withColumn("__a", F.lit(True)), second.select(*keys).distinct().withColumn("__b", F.lit(True))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("__a", F.lit(False)).alias("in_first"), F.coalesce("__b", F.lit(False)).alias("in_second"))


def enhancement(arterial: str = "arterial", venous: str = "venous", delayed: str = "delayed", weights: tuple[float, float, float] = (0.5, 0.25, 0.25)):
    """Weighted positive parts of the differences arterial - venous, arterial - delayed and venous - delayed of normalized phases."""
    part = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0.0))
    return F.lit(weights[0]) * part(arterial, venous) + F.lit(weights[1]) * part(arterial, delayed) + F.lit(weights[2]) * part(venous, delayed)


def chunk_violations(chunks: DataFrame, most: int) -> DataFrame:
    """(chunk_id, rule) for chunks without required fields, with repeated ids, or whose token count is wrong or too high."""
    from ..functions.text import token_count

    repeated = F.count("*").over(Window.partitionBy("chunk_id")) > 1
    rules = {
        "field_missing": F.coalesce(F.length("chunk_id") == 0, F.lit(True)) | F.coalesce(F.length("text") == 0, F.lit(True)) | F.coalesce(F.length("section") == 0, F.lit(True)),
        "id_repeated": F.col("__repeated"),
        "count_wrong": F.col("token_count") != token_count(F.col("text")),
        "too_long": F.col("token_count") > most,
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return chunks.withColumn("__repeated", repeated).select("chunk_id", F.explode(found).alias("rule"))
