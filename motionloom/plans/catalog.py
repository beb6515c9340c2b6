"""Formula catalogue and teaching context of an analysed experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Keys = Sequence[str]

# fixed values: formula ids, their experiment type and expression
FORMULAS = (
    ("uniform.s", "uniform_linear", "s = s0 + v t"),
    ("accel.s", "uniform_accel", "s = s0 + v0 t + (1/2) a t^2"),
    ("freefall.y", "free_fall", "y = y0 + v0y t + (1/2) g t^2"),
    ("projectile.xy", "projectile", "x = x0 + v0x t;  y = y0 + v0y t + (1/2) g t^2"),
    ("pendulum.period", "pendulum", "T = 2π √(L / g)"),
    ("pendulum.g", "pendulum", "g = 4π^2 L / T^2"),
)
CATALOG_VERSION = "1.0.0"

SECTION_TITLES = ("Purpose", "Equipment and data", "Principle", "Formulas and results", "Errors", "Conclusion")


def formula_table(spark: SparkSession) -> DataFrame:
    """Six fixed rows; joins broadcast it."""
    return spark.createDataFrame(list(FORMULAS), "formula_id string, experiment_type string, expression string")


def formulas_for(kinds: DataFrame, kind: str = "experiment_type") -> DataFrame:
    """Formulas of each row's type; rows of unknown type drop."""
    table = formula_table(kinds.sparkSession).withColumnRenamed("experiment_type", kind)
    return kinds.join(F.broadcast(table), kind)


def pick_candidate(analysis: DataFrame, confirmed: Column | None) -> DataFrame:
    """Add ``candidate``: the listed one of the confirmed type, else the selected one."""
    chosen = F.col("selected")
    if confirmed is not None:
        named = F.get(F.filter("candidates", lambda c: c["experiment_type"] == confirmed), F.lit(0))
        chosen = F.coalesce(named, chosen)
    return analysis.withColumn("candidate", chosen)


def teaching_context(picked: DataFrame, points: DataFrame, keys: Keys, *, level: str = "high") -> DataFrame:
    """keys, context: JSON of results, warnings and at most 24 representative points.

    ``points`` come from timeline.representative_points, so the array per track is bounded.
    """
    keys = list(keys)
    shown = F.struct("frame", F.bround("time_s", 4).alias("t"), F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"), F.col("position_unit").alias("unit"))
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(shown)).alias("representative_points"))
    c = F.col("candidate")
    results = F.struct(
        c.isNotNull().alias("available"), c["experiment_type"].alias("experiment_type"), F.bround(c["confidence"], 4).alias("confidence"),
        c["parameters"].alias("parameters"), c["units"].alias("units"), F.bround(c["r2"], 4).alias("r2"), F.bround(c["nrmse"], 4).alias("nrmse"),
        c["n_samples"].alias("n_samples"), F.array(c["time_start_s"], c["time_end_s"]).alias("time_range_s"),
        F.array(c["frame_start"], c["frame_end"]).alias("frame_range"), F.bround(F.col("coverage"), 4).alias("coverage"), F.col("position_unit").alias("position_unit"),
    )
    body = F.to_json(F.struct(F.lit(level).alias("teaching_level"), results.alias("results"), "missing", "warnings", "representative_points"))
    return picked.join(packed, keys, "left").select(*keys, body.alias("context"))


def chat_messages(history: DataFrame, questions: DataFrame, keys: Keys, system_prompt: str) -> DataFrame:
    """keys, messages: system prompt, the kept history in order, then the question."""
    keys = list(keys)
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    packed = history.groupBy(*keys).agg(said.alias("_h"))
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    rows = questions.join(packed, keys, "left")
    middle = F.coalesce("_h", F.slice(one("user", F.lit("")), 1, 0))
    return rows.select(*keys, F.concat(one("system", F.lit(system_prompt)), middle, one("user", F.col("question"))).alias("messages"))


def report_messages(contexts: DataFrame, keys: Keys, system_prompt: str, instruction: str, *, level: str = "high") -> DataFrame:
    """keys, messages: the system prompt with its instruction, then the task with the JSON ``context``."""
    head = F.to_json(F.struct(F.lit(level).alias("teaching_level"), F.lit("experiment_report_sections").alias("task"), F.lit(True).alias("json")))
    task = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"context":'), F.coalesce("context", F.lit("null")), F.lit("}"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return contexts.select(*keys, F.array(message("system", F.lit(f"{system_prompt}\n{instruction}")), message("user", task)).alias("messages"))


def report_markdown(picked: DataFrame, keys: Keys, stamp: Column, *, level: str = "high", stale: Column | None = None) -> DataFrame:
    """keys, markdown: six sections whose numbers all come from the analysis."""
    c = F.col("candidate")
    na = "not computable"
    title = F.coalesce(c["experiment_type"], F.lit("unconfirmed"))
    facts = F.concat_ws(
        "\n",
        F.when(F.col("calibration_active"), F.concat(F.lit("- calibration: on, unit "), F.col("position_unit"))).otherwise("- calibration: none, unit px"),
        F.format_string("- track coverage: %.3f", F.col("coverage")),
        F.format_string("- mean track confidence: %.3f", F.col("mean_track_confidence")),
        F.when(F.size("missing") > 0, F.concat(F.lit("- missing: "), F.concat_ws(", ", "missing"))),
        F.when(c.isNotNull(), F.format_string("- fitted frames %d-%d, %.3f-%.3f s, %d samples", c["frame_start"], c["frame_end"], c["time_start_s"], c["time_end_s"], c["n_samples"])),
    )
    formulas = F.lit("- (no confirmed type)")
    for kind in dict.fromkeys(k for _, k, _ in FORMULAS):
        lines = "\n".join(f"- `{text}` ({fid})" for fid, k, text in FORMULAS if k == kind)
        formulas = F.when(c["experiment_type"] == kind, lines).otherwise(formulas)
    values = F.transform(
        F.array_sort(F.map_keys(c["parameters"])),
        lambda k: F.concat(F.lit("- "), k, F.coalesce(F.concat(F.lit(" = "), F.format_string("%.6g", F.try_element_at(c["parameters"], k)), F.lit(" "), F.try_element_at(c["units"], k)), F.lit(f": {na}"))),
    )
    results = F.when(
        c.isNotNull(),
        F.concat_ws("\n", F.format_string("- confidence: %.3f\n- R²: %.4f\n- NRMSE: %.4f", c["confidence"], c["r2"], c["nrmse"]), F.concat_ws("\n", values),
                    F.when(F.size("warnings") > 0, F.concat(F.lit("- warnings: "), F.concat_ws(", ", "warnings")))),
    ).otherwise(f"{na}: no confirmed type or no local fit")
    bodies = (F.lit("(no text)"), facts, formulas, results, F.lit("See residuals and missing conditions."), F.lit("(no text)"))
    sections = [F.concat(F.lit(f"## {t}\n\n"), b, F.lit("\n")) for t, b in zip(SECTION_TITLES, bodies)]
    head = F.concat(F.lit("# Report: "), title, F.lit("\n\n- generated: "), stamp, F.lit(f"\n- level: {level}\n"))
    old = F.when(F.coalesce(stale, F.lit(False)), "- state: data changed, results are old\n") if stale is not None else F.lit(None).cast("string")
    return picked.select(*keys, F.concat_ws("\n", head, old, *sections, F.lit("All numbers come from the local fit.")).alias("markdown"))


def fingerprint_points(points: DataFrame, keys: Keys) -> DataFrame:
    """Order-free digest of a track: equal tracks, and only those, give the same token.

    Each point is hashed with its frame; the hashes are added as decimals, so partial sums
    combine map-side and a hot track is never gathered.
    """
    text = F.concat_ws(
        "|", "frame", F.format_string("%.4f", "x"), F.format_string("%.4f", "y"), F.col("visible").cast("string"),
        F.format_string("%.4f", "confidence"), F.col("manual").cast("string"),
    )
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(part(1)).alias("_a"), F.sum(part(13)).alias("_b"), F.sum(part(25)).alias("_c"))
    token = F.sha2(F.concat_ws("|", "_n", F.col("_a").cast("string"), F.col("_b").cast("string"), F.col("_c").cast("string")), 256)
    return sums.select(*keys, F.substring(token, 1, 24).alias("fingerprint"))
