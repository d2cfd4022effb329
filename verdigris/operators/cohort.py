"""Cohort construction: key rules, registry and curation checks, series classification and choice, phases, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import namespace, stripped_of_accents

# Closed vocabularies of labels, subtypes and tags, and of registry fields.
NEGATIVE_SUBTYPES = ("normal", "benign_anatomic_variant", "pseudolesion_or_artifact", "benign_non_target_finding", "poor_quality_non_diagnostic")
POSITIVE_SUBTYPES = ("focal_lesion_suspicious", "hcc_suspicious", "metastasis_suspicious", "hemangioma_or_benign_lesion_visible", "cyst_or_benign_lesion_visible", "abscess_or_inflammatory_suspicion", "other_pathologic_suspicion")
PHENOTYPE_TAGS = ("prominent_hepatic_vein", "portal_vein_variant", "vascular_structure", "perfusion_alteration", "motion_artifact", "partial_volume_effect", "focal_fat", "simple_cyst", "edge_of_liver_pseudolesion", "arterial_hyperenhancement", "washout_suspicion", "diffusion_restriction", "t2_hyperintense_focus")
RAG_CLASSES, SOURCE_FORMATS, MODALITIES = ("negative", "positive"), ("dicom", "nifti"), ("MR",)
REVIEW_STATES = ("pending_review", "reviewed", "rejected")

# Sequence classes with the words that name them, in the order in which they are tried.
SEQUENCE_RULES = (
    ("ADC", ("adc",)),
    ("DWI", ("dwi", "diff", "ep2d")),
    ("T2", ("t2", "haste", "ssfp")),
    ("T1_OUT_PHASE", ("outphase", "out phase", "opposed", "op fase")),
    ("T1_IN_PHASE", ("inphase", "in phase", "in fase")),
    ("T1_ARTERIAL", ("arterial", "art phase", "art fase")),
    ("T1_PORTAL", ("portal", "venous", "venosa")),
    ("T1_DELAYED", ("delayed", "delay", "tardia", "equilibrium", "5 min")),
    ("T1_POST_CONTRAST", ("post", "+c", "gad", "contrast")),
    ("T1_UNSPECIFIED", ("pre", "t1", "vibe", "dixon", "dual")),
)
# Quality points of a sequence class, and the classes' order when one series is chosen for a case.
SEQUENCE_POINTS = {"DWI": 20, "ADC": 18, "T2": 16, "T1_ARTERIAL": 20, "T1_PORTAL": 20, "T1_DELAYED": 18, "T1_POST_CONTRAST": 16, "T1_IN_PHASE": 10, "T1_OUT_PHASE": 10, "T1_UNSPECIFIED": 8, "UNKNOWN": 0}
BEST_PRIORITY = {"T1_ARTERIAL": 100, "T1_PORTAL": 95, "DWI": 90, "ADC": 85, "T2": 80, "T1_DELAYED": 75, "T1_POST_CONTRAST": 70, "T1_IN_PHASE": 60, "T1_OUT_PHASE": 55, "T1_UNSPECIFIED": 40, "UNKNOWN": 0}
PRIMARY_PRIORITY = {"T1_ARTERIAL": 100, "T1_PORTAL": 95, "T1_DELAYED": 90, "T1_POST_CONTRAST": 85, "DWI": 80, "ADC": 75, "T2": 70, "T1_IN_PHASE": 60, "T1_OUT_PHASE": 55, "T1_UNSPECIFIED": 40, "UNKNOWN": 0}
# Folder names of the three phases without separators and accents, and words of explicit phase labels.
PHASES = ("t1_arterial", "t1_venous", "t1_delayed")
PHASE_ALIASES = {
    "t1_arterial": ("arterial", "art", "arterialphase", "fasearterial", "t1arterial", "ap"),
    "t1_venous": ("venous", "venoso", "venosa", "portal", "portalvenous", "fasevenosa", "t1venous", "pv", "vp"),
    "t1_delayed": ("delayed", "tardio", "tardia", "late", "fasetardia", "t1delayed", "equilibrio", "equilibrium"),
}
PHASE_WORDS = {
    "t1_arterial": ("arterial", "art phase", "fase art", "t1 art"),
    "t1_venous": ("portal venous", "portal", "venous", "venosa", "venoso", "t1 pv"),
    "t1_delayed": ("delayed", "delay", "late phase", "tardia", "tardio", "equilibrium", "equilibrio"),
}


def _any_word(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def _lookup(column: Column, table: dict, default: object) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), column), F.lit(default))


# --- keys


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def conflicting_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in any column."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)])), 256)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(content).alias("versions")).where("versions > 1")


def collapsed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key; an error while it runs if rows of one key differ."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)])), 256)
    grouped = rows.withColumn("__h", content).groupBy(*keys).agg(F.count_distinct("__h").alias("__v"), *[F.first(c).alias(c) for c in rows.columns if c not in keys])
    return grouped.withColumn("__ok", F.when(F.col("__v") > 1, F.raise_error(F.lit("rows of one key differ"))).otherwise(F.lit(True))).where("__ok").select(*rows.columns)


def pending(universe: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no checkpoint has yet: a job that is run again does only these."""
    return universe.join(done.select(*keys).distinct(), list(keys), "left_anti")


# --- registry and curation


def registry_violations(registry: DataFrame) -> DataFrame:
    """(case_id, rule) for everything in registry rows that breaks a rule."""
    label, negative, positive = F.col("rag_class"), F.col("negative_subtype"), F.col("positive_subtype")
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    rules = {
        "dataset_missing": blank(F.col("dataset_id")) | blank(F.col("dataset_name")),
        "rag_class_unknown": ~F.coalesce(label.isin(*RAG_CLASSES), F.lit(False)),
        "source_format_unknown": ~F.coalesce(F.col("source_format").isin(*SOURCE_FORMATS), F.lit(False)),
        "modality_unknown": ~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)),
        "not_research_only": ~F.coalesce(F.col("research_only") & ~F.col("clinical_use_allowed"), F.lit(False)),
        "positive_subtype_on_negative": (label == "negative") & positive.isNotNull(),
        "negative_subtype_on_positive": (label == "positive") & negative.isNotNull(),
        "negative_subtype_unknown": negative.isNotNull() & ~negative.isin(*NEGATIVE_SUBTYPES),
        "positive_subtype_unknown": positive.isNotNull() & ~positive.isin(*POSITIVE_SUBTYPES),
        "tag_unknown": F.coalesce(F.exists("phenotype_tags", lambda t: ~t.isin(*PHENOTYPE_TAGS)), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return registry.select("case_id", F.explode(found).alias("rule"))


def curation_rows(rows: DataFrame) -> DataFrame:
    """Curation rows with trimmed, lower-cased fields; a missing recommendation keeps the current label, a missing status is pending."""
    token = lambda c: F.lower(F.trim(F.nullif(F.col(c), F.lit(""))))
    tags = F.filter(F.transform(F.coalesce("phenotype_tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return rows.select(F.trim("case_id").alias("case_id"), token("current_label").alias("current_label"), F.coalesce(token("recommended_label"), token("current_label")).alias("recommended_label"), token("recommended_negative_subtype").alias("negative_subtype"), token("recommended_positive_subtype").alias("positive_subtype"), tags.alias("phenotype_tags"), F.trim("reviewer").alias("reviewer"), F.coalesce(token("review_status"), F.lit("pending_review")).alias("review_status"))


def curation_violations(rows: DataFrame) -> DataFrame:
    """(case_id, rule) for curation rows in their canonical form."""
    negative, positive = F.col("negative_subtype"), F.col("positive_subtype")
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    rules = {
        "case_missing": blank(F.col("case_id")),
        "label_unknown": ~F.coalesce(F.col("current_label").isin("positive", "negative") & F.col("recommended_label").isin("positive", "negative"), F.lit(False)),
        "reviewer_missing": blank(F.col("reviewer")),
        "status_unknown": ~F.col("review_status").isin(*REVIEW_STATES),
        "both_subtypes": negative.isNotNull() & positive.isNotNull(),
        "negative_subtype_unknown": negative.isNotNull() & ~negative.isin(*NEGATIVE_SUBTYPES),
        "positive_subtype_unknown": positive.isNotNull() & ~positive.isin(*POSITIVE_SUBTYPES),
        "negative_subtype_on_positive": negative.isNotNull() & (F.col("recommended_label") != "negative"),
        "positive_subtype_on_negative": positive.isNotNull() & (F.col("recommended_label") != "positive"),
        "tag_unknown": F.exists("phenotype_tags", lambda t: ~t.isin(*PHENOTYPE_TAGS)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return rows.select("case_id", F.explode(found).alias("rule"))


def curation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("review_status") == "reviewed").alias("reviewed"), F.count_if(F.col("recommended_label") != F.col("current_label")).alias("reclassified"), F.count("negative_subtype").alias("negative_subtypes"), F.count("positive_subtype").alias("positive_subtypes"))


def protected_labels(rows: DataFrame) -> DataFrame:
    """Labels of reviewed cases only."""
    return rows.where("review_status = 'reviewed'").select("case_id", F.col("recommended_label").alias("label"), "negative_subtype", "positive_subtype", "phenotype_tags")


# --- series


def classify_sequence(text: Column, b_value: Column | None = None) -> Column:
    """The first class whose words the text has; a positive b-value means diffusion unless the text says ADC."""
    flat = F.regexp_replace(F.lower(text), "[^a-z0-9+#]+", " ")
    out = F.lit("UNKNOWN")
    for name, words in reversed(SEQUENCE_RULES):
        test = _any_word(flat, words)
        if name == "DWI" and b_value is not None:
            test = test | (F.coalesce(b_value, F.lit(0.0)) > 0)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def _normal(orientation: Column) -> list[Column]:
    r, c = [orientation[i] for i in range(3)], [orientation[i + 3] for i in range(3)]
    return [r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0]]


def orientation_of(orientation: Column) -> Column:
    """sagittal, coronal or axial by the largest part of the slice normal (equal parts: the first); unknown without six numbers."""
    a, b, c = (F.abs(x) for x in _normal(orientation))
    name = F.when((a >= b) & (a >= c), "sagittal").when(b >= c, "coronal").otherwise("axial")
    return F.when(F.coalesce(F.size(orientation) == 6, F.lit(False)), name).otherwise("unknown")


def slice_position(orientation: Column, position: Column) -> Column:
    normal = _normal(orientation)
    value = normal[0] * position[0] + normal[1] * position[1] + normal[2] * position[2]
    return F.when((F.size(orientation) == 6) & (F.size(position) == 3), value)


def geometry(slices: DataFrame, key: str = "series_key", position: str = "position", instance: str = "instance_number") -> DataFrame:
    """Per series: different positions (4 decimals), repeated ones, repeated instance numbers, median spacing, whether spacing varies."""
    rows = slices.withColumn("__p", F.round(position, 4))
    places = rows.where(F.col("__p").isNotNull()).select(key, "__p").distinct()
    steps = places.withColumn("d", F.col("__p") - F.lag("__p").over(Window.partitionBy(key).orderBy("__p")))
    middle = steps.groupBy(key).agg(F.count("*").alias("unique_slice_positions"), F.round(F.median("d"), 4).alias("median_slice_spacing"))
    tolerance = F.greatest(F.lit(0.2), F.abs("median_slice_spacing") * 0.1)
    uneven = steps.join(middle, key).groupBy(key).agg(F.coalesce(F.bool_or((F.col("median_slice_spacing") != 0) & (F.abs(F.col("d") - F.col("median_slice_spacing")) > tolerance)), F.lit(False)).alias("nonuniform_slice_spacing"))
    counts = rows.groupBy(key).agg(F.count("__p").alias("__n"), (F.count(instance) - F.count_distinct(instance)).alias("duplicate_instance_numbers"))
    out = counts.join(middle, key, "left").join(uneven, key, "left").na.fill({"unique_slice_positions": 0, "nonuniform_slice_spacing": False})
    return out.withColumn("duplicate_slice_positions", F.greatest(F.lit(0), F.col("__n") - F.col("unique_slice_positions"))).drop("__n")


def quality_score(series: DataFrame) -> DataFrame:
    """Adds quality_score (floor 0) and warnings from modality, orientation, frames, sequence_class and the geometry flags."""
    modality, axis = F.col("modality") == "MR", F.col("orientation")
    flags = {
        "modality_not_mr": ~modality,
        "orientation_unknown": axis == "unknown",
        "insufficient_slices": F.col("frames") < 16,
        "nonuniform_slice_spacing": F.col("nonuniform_slice_spacing"),
        "duplicate_slice_positions": F.col("duplicate_slice_positions") > 0,
        "mixed_matrix_size": F.col("matrix_sizes") > 1,
        "dicom_read_errors": F.col("read_errors") > 0,
    }
    points = F.when(modality, 40).otherwise(0) + F.when(axis == "axial", 20).otherwise(0) + F.when(F.col("frames") >= 16, 20).otherwise(0) + _lookup(F.col("sequence_class"), SEQUENCE_POINTS, 0)
    for name, cost in (("nonuniform_slice_spacing", 20), ("duplicate_slice_positions", 10), ("mixed_matrix_size", 20), ("dicom_read_errors", 10)):
        points = points - F.when(flags[name], cost).otherwise(0)
    warnings = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]), lambda w: w.isNotNull())
    return series.withColumns({"quality_score": F.greatest(points, F.lit(0)), "warnings": warnings})


def _eligible(series: DataFrame, least_slices: int) -> DataFrame:
    return series.where((F.col("modality") == "MR") & (F.col("frames") >= least_slices) & (F.col("quality_score") >= (60 if least_slices >= 16 else 40)))


def best_series(series: DataFrame, by: str = "case_id", least_slices: int = 3) -> DataFrame:
    """Each case's best eligible series: score, class priority, frames, key."""
    order = F.struct("quality_score", _lookup(F.col("sequence_class"), BEST_PRIORITY, 0).alias("p"), "frames", "series_key")
    return _eligible(series, least_slices).groupBy(by).agg(F.count("*").alias("candidates"), F.max_by(F.struct("series_key", "sequence_class", "quality_score", "frames"), order).alias("b")).select(by, "candidates", "b.*")


def best_series_by_class(series: DataFrame, by: str = "case_id", least_slices: int = 3) -> DataFrame:
    """The best series of every class of a case, and which of them is primary."""
    best = _eligible(series, least_slices).groupBy(by, "sequence_class").agg(F.max(F.struct("quality_score", "frames", "series_key")).alias("b")).select(by, "sequence_class", "b.*")
    place = F.row_number().over(Window.partitionBy(by).orderBy(_lookup(F.col("sequence_class"), PRIMARY_PRIORITY, 0).desc(), F.desc("quality_score"), F.desc("frames"), F.desc("series_key")))
    return best.withColumn("primary", place == 1)


def eligible_distribution(series: DataFrame, label: str = "label") -> DataFrame:
    """Eligible series by label and class, and whether the other labels have the class at all."""
    counts = series.groupBy(label, "sequence_class").agg(F.count("*").alias("series"))
    labels = counts.agg(F.count_distinct(label).alias("__l"))
    spread = counts.groupBy("sequence_class").agg(F.count("*").alias("__has"))
    return counts.join(spread, "sequence_class").join(F.broadcast(labels), F.col("__has") <= F.col("__l")).withColumn("in_all_labels", F.col("__has") == F.col("__l")).drop("__has", "__l")


# --- phases


def phase_of_folder(name: Column) -> Column:
    """The phase that a folder's name stands for, null for none."""
    token = F.regexp_replace(stripped_of_accents(name), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for phase, names in PHASE_ALIASES.items():
        out = F.when(token.isin(*names), F.lit(phase)).otherwise(out)
    return out


def explicit_phase(text: Column) -> Column:
    """The phase that a text names if it names exactly one."""
    named = F.filter(F.array(*[F.when(_any_word(text, words), F.lit(phase)) for phase, words in PHASE_WORDS.items()]), lambda p: p.isNotNull())
    return F.when(F.size(named) == 1, named[0])


def time_of_day(text: Column) -> Column:
    """Seconds of a HHMMSS.fraction time, null for shorter ones."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.]", "")
    whole = F.substring_index(digits, ".", 1)
    fraction = F.coalesce(F.concat(F.lit("0."), F.nullif(F.regexp_extract(digits, r"\.([0-9]+)$", 1), F.lit(""))).cast("double"), F.lit(0.0))
    part = lambda a: F.substring(whole, a, 2).cast("double")
    return F.when(F.length(whole) >= 6, part(1) * 3600 + part(3) * 60 + part(5) + fraction)


def dynamic_phases(series: DataFrame, study: str = "study") -> DataFrame:
    """First, second and last dynamic series of each study that has three or more in an order without ties.

    Explicit labels win where every phase is labelled once; else the order is that of acquisition
    times, or of series numbers where a time is missing. Columns: series_key, role, dynamic,
    acquisition_seconds, series_number. Returns study, strategy and the three series.
    """
    usable = series.where("dynamic")
    labelled = usable.where(F.col("role").isNotNull()).groupBy(study).agg(F.count("*").alias("n"), F.count_distinct("role").alias("r"), *[F.max(F.when(F.col("role") == p, F.col("series_key"))).alias(p) for p in PHASES]).where("n = 3 and r = 3")
    explicit = labelled.select(study, F.lit("explicit").alias("strategy"), *PHASES)
    rest = usable.join(explicit.select(study), study, "left_anti")
    all_timed = rest.groupBy(study).agg((F.count("acquisition_seconds") == F.count("*")).alias("timed"), (F.count("series_number") == F.count("*")).alias("numbered"))
    keyed = rest.join(all_timed, study).where("timed or numbered").withColumn("k", F.when(F.col("timed"), F.col("acquisition_seconds")).otherwise(F.col("series_number").cast("double")))
    ordered = keyed.groupBy(study).agg(F.count("*").alias("n"), F.count_distinct("k").alias("d"), F.transform(F.array_sort(F.collect_list(F.struct("k", "series_key"))), lambda s: s["series_key"]).alias("s")).where("n >= 3 and n = d")
    by_time = ordered.select(study, F.lit("ordered").alias("strategy"), F.col("s")[0].alias(PHASES[0]), F.col("s")[1].alias(PHASES[1]), F.element_at("s", -1).alias(PHASES[2]))
    return explicit.unionByName(by_time)


# --- provenance and reports


def provenance_verdicts(cases: DataFrame, training: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """in_sample, out_of_sample or unknown for cases (case_id, patient_group_id) against training rows of the same columns.

    ``provenance`` (id, original) renames identifiers first. Unmatched identifiers are out of
    sample only if the training set uses their namespace; otherwise nothing can be said.
    """
    rows = cases.withColumn("patient_group_id", F.coalesce("patient_group_id", "case_id"))
    for column in ("case_id", "patient_group_id"):
        name = f"__{column}"
        if provenance is None:
            rows = rows.withColumn(name, F.col(column))
        else:
            names = provenance.select(F.col("id").alias(f"{name}_id"), F.col("original").alias(f"{name}_to"))
            rows = rows.join(names, F.col(column) == F.col(f"{name}_id"), "left").withColumn(name, F.coalesce(f"{name}_to", column)).drop(f"{name}_id", f"{name}_to")
    ids = training.select(F.col("case_id").alias("__case_id")).distinct().withColumn("by_case", F.lit(True))
    groups = training.select(F.col("patient_group_id").alias("__patient_group_id")).distinct().withColumn("by_group", F.lit(True))
    spaces = training.select(F.explode(F.array("case_id", "patient_group_id")).alias("id")).where("trim(id) <> ''").select(namespace(F.col("id")).alias("__space")).distinct()
    rows = rows.join(ids, "__case_id", "left").join(groups, "__patient_group_id", "left")
    for k, column in enumerate(("__case_id", "__patient_group_id")):
        rows = rows.withColumn(f"__s{k}", namespace(F.col(column))).join(spaces.withColumnsRenamed({"__space": f"__s{k}"}).withColumn(f"__k{k}", F.lit(True)), f"__s{k}", "left")
    seen = F.coalesce(F.col("by_case"), F.lit(False)) | F.coalesce(F.col("by_group"), F.lit(False))
    comparable = F.coalesce(F.col("__k0"), F.lit(False)) | F.coalesce(F.col("__k1"), F.lit(False))
    return rows.withColumn("verdict", F.when(seen, "in_sample").when(comparable, "out_of_sample").otherwise("unknown")).select(*cases.columns, "verdict")


def verdict_ids(verdicts: DataFrame) -> DataFrame:
    """One row a verdict: how many cases and their ids in order. The lists are for reports of a cohort; ``verdict_partition`` gives counts of any table."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("cases"), F.array_sort(F.collect_list(F.col("case_id").cast("string"))).alias("case_ids"))


#: The phases that a case needs.
REQUIRED_PHASES = ("t1_arterial", "t1_venous", "t1_delayed")


def phase_folder_problems(folders: DataFrame, required: Sequence[str] = REQUIRED_PHASES) -> DataFrame:
    """(case_id, rule, phase) for cases of folders (case_id, folder): phases that several folders claim, and required ones that none does."""
    named = folders.select("case_id", phase_of_folder(F.col("folder")).alias("phase"))
    claims = named.groupBy("case_id", "phase").agg(F.count("*").alias("n"))
    ambiguous = claims.where("phase is not null and n > 1").select("case_id", F.lit("ambiguous").alias("rule"), "phase")
    wanted = F.explode(F.array_except(F.array(*[F.lit(p) for p in required]), F.coalesce("have", F.array().cast("array<string>"))))
    missing = named.groupBy("case_id").agg(F.collect_set("phase").alias("have")).select("case_id", F.lit("missing").alias("rule"), wanted.alias("phase"))
    return ambiguous.union(missing)


def verdict_partition(verdicts: DataFrame) -> DataFrame:
    """How many cases have each verdict; ids stay in the rows, where they can be filtered."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("cases"))


def subjects(registry: DataFrame, by: str = "subject") -> DataFrame:
    """Registry rows by subject: roles, formats and datasets, and whether the subject mixes any of them."""
    out = registry.groupBy(by).agg(F.count("*").alias("series"), F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("source_format")).alias("formats"), F.array_sort(F.collect_set("dataset_id")).alias("datasets"))
    return out.withColumn("mixed", (F.size("roles") > 1) | (F.size("formats") > 1))


def confounded(registry: DataFrame) -> DataFrame:
    """Subjects and datasets of each role, and whether no dataset has more than one role, so that role and dataset cannot be told apart."""
    roles = registry.groupBy("role").agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("dataset_id").alias("datasets"))
    shared = registry.groupBy("dataset_id").agg(F.count_distinct("role").alias("r")).agg(F.coalesce(F.max("r"), F.lit(0)).alias("most"))
    return roles.join(F.broadcast(shared), F.col("most") >= 0).withColumn("confounded", F.col("most") <= 1).drop("most")


def failure_class(message: Column, markers: Sequence[str]) -> Column:
    """invalid_response if the lower-cased message has one of the markers, else failure."""
    return F.when(_any_word(F.lower(F.coalesce(message, F.lit(""))), markers), "invalid_response").otherwise("failure")


def time_gate(report: Column, seconds: Column, budget: float = 180.0) -> Column:
    """Whether a report exists and was in time; null where no time was measured."""
    return F.when(seconds.isNotNull(), report & (seconds <= budget))


def support_distribution(rows: DataFrame, value: str, cuts: Sequence[int]) -> DataFrame:
    """Least support, how many have exactly one, and how many lie under each cut."""
    return rows.agg(F.min(value).alias("minimum"), F.count_if(F.col(value) == 1).alias("equal_1"), *[F.count_if(F.col(value) < c).alias(f"under_{c}") for c in cuts])


def label_columns(rows: DataFrame, forbidden: Sequence[str]) -> list[str]:
    """Paths of columns and nested fields that a label-blind table must not have."""
    found: list[str] = []

    def walk(schema, path: str) -> None:
        for field in getattr(schema, "fields", []):
            here = f"{path}{field.name}"
            if field.name.lower() in forbidden:
                found.append(here)
            kind = field.dataType
            while hasattr(kind, "elementType"):
                kind = kind.elementType
            walk(getattr(kind, "valueType", kind), f"{here}.")

    walk(rows.schema, "")
    return found
