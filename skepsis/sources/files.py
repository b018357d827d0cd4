"""File sources and sinks: catalogues, result and trace tables, value files, exports, manifests."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import col
from ..operators.sphere import normalize, radec_to_unit, unit_to_radec

# Recognised catalogue column names.
CATALOGUE_NAMES = ("ra", "dec", "x", "y", "z", "energy")


def catalogue_schema(first_line: str) -> tuple[str, list[str] | None]:
    """(delimiter regex, header or None) from the first line that is neither blank nor a comment."""
    comma = "," in first_line
    parts = [p.strip().lower() for p in (first_line.split(",") if comma else first_line.split())]
    header = parts if any(p in CATALOGUE_NAMES for p in parts) else None
    return ("," if comma else r"\s+"), header


def sniff_catalogue(lines: DataFrame) -> tuple[str, list[str] | None]:
    """Look at one line of the file (a bounded read) to fix the column positions of the plan."""
    row = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).head()
    return catalogue_schema(row["value"]) if row else (",", None)


def parse_catalogue(lines: DataFrame, delimiter: str, header: list[str] | None) -> DataFrame:
    """(ux, uy, uz, energy) from text lines.

    A cell keeps its position when it is blank (it becomes NULL).  A row with text in any cell, or
    without usable coordinates, is dropped.
    """
    text = lines.select(F.trim("value").alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    if header:
        text = text.filter(F.lower(F.regexp_replace("line", r"\s+", "")) != "".join(
            (",".join(header) if delimiter == "," else "".join(header)).split()))
    parts = F.transform(F.split("line", delimiter), lambda p: F.trim(p))
    d = text.select(parts.alias("_p")).withColumn("_n", F.transform("_p", lambda p: F.when(p != "", p.try_cast("double"))))
    bad = F.exists(F.arrays_zip("_p", "_n"), lambda s: (s["_p"] != "") & s["_n"].isNull())
    d = d.filter(~bad)
    at = lambda name: F.get(F.col("_n"), header.index(name)) if name in header else F.lit(None).cast("double")
    if header:
        energy = at("energy")
        if all(c in header for c in "xyz"):
            x, y, z = at("x"), at("y"), at("z")
            d = d.select(x.alias("_a"), y.alias("_b"), z.alias("_c"), energy.alias("energy")).na.drop(subset=["_a", "_b", "_c"])
            ux, uy, uz = normalize("_a", "_b", "_c")
            return d.select(ux.alias("ux"), uy.alias("uy"), uz.alias("uz"), "energy")
        ra, dec = at("ra"), at("dec")
    else:
        ra, dec, energy = (F.get(F.col("_n"), i) for i in range(3))
    d = d.select(ra.alias("_a"), dec.alias("_b"), energy.alias("energy")).na.drop(subset=["_a", "_b"])
    ux, uy, uz = radec_to_unit("_a", "_b")
    return d.select(ux.alias("ux"), uy.alias("uy"), uz.alias("uz"), "energy")


def read_catalogue(spark: SparkSession, path: str, energy_cut: float | None = None) -> DataFrame:
    """Directions of an observed catalogue, CSV or whitespace, with or without a header."""
    lines = spark.read.text(path)
    out = parse_catalogue(lines, *sniff_catalogue(lines))
    if energy_cut is not None:
        out = out.filter(F.col("energy").isNull() | (F.col("energy") >= energy_cut))
    return out


def write_catalogue(df: DataFrame, path: str) -> None:
    """ra, dec (6 decimals) and energy as CSV with a header."""
    ra, dec = unit_to_radec("ux", "uy", "uz")
    df.select(F.format_string("%.6f", ra).alias("ra"), F.format_string("%.6f", dec).alias("dec"), "energy").write.csv(path, header=True)


def write_directions(df: DataFrame, path: str) -> None:
    """x, y, z and energy in full digits as CSV with a header: a catalogue that reads back as it was written."""
    df.select(F.col("ux").alias("x"), F.col("uy").alias("y"), F.col("uz").alias("z"), "energy").write.csv(path, header=True)


# The 16 columns of a result row.
RESULT_SCHEMA = ("candidate_id bigint, cr double, ci double, score double, pearson double, spearman double, mae double, gradient double, "
                 "spectral double, autocorr double, entropy double, anisotropy double, levels int, dominant double, rle double, status string")


def read_result_tsv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Result rows.  Malformed rows are dropped, or kept with `_corrupt_record` when strict.

    Every line is parsed whole, whichever columns are selected later, so the rows kept never depend on the selection.
    """
    row = F.from_csv(F.col("value"), RESULT_SCHEMA + ", _corrupt_record string", {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = spark.read.text(path).filter(F.length("value") > 0).select(row.alias("_r")).select("_r.*")
    return d if strict else d.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


TRACE_SCHEMA = ("iter bigint, active_frac double, mean_abs_z double, std_abs_z double, mean_zr double, mean_zi double, "
                "esc_frac double, driver double, prime int")


def read_trace_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Trace with a header; a missing cell is 0."""
    d = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False).schema(TRACE_SCHEMA).csv(path)
    return d.fillna(0).withColumnRenamed("iter", "t")


def read_value_file(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated numbers -> (file, t, v).

    Lines are read in parallel; a value's position is its place in the line plus the counts of the
    lines before it, so a large file is not one row.  Lines are ordered by the start of their split in
    the file, then by their order in the task that reads the split.
    """
    d = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_ln"), F.filter(F.split(F.trim("value"), r"\s+"), lambda p: p != "").alias("_p"))
    from pyspark.sql import Window as W
    from ..operators.scale import materialize
    d = materialize(d.withColumn("_n", F.size("_p")))  # fixes the line ids before they are used twice
    line = F.floor(F.col("_ln") / 4096)
    chunk = ["file", "_blk", "_c"]
    tot = d.withColumn("_c", line).groupBy(*chunk).agg(F.sum("_n").alias("_t"))
    base = tot.select(*chunk, F.coalesce(F.sum("_t").over(W.partitionBy("file").orderBy("_blk", "_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = F.coalesce(F.sum("_n").over(W.partitionBy(*chunk).orderBy("_ln").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_c", line).withColumn("_in", inner).join(base, chunk)
    return d.select("file", (F.col("_off") + F.col("_in")).alias("_s"), F.posexplode("_p").alias("_i", "_v")).select(
        "file", (F.col("_s") + F.col("_i") + 1).cast("bigint").alias("t"), F.col("_v").try_cast("double").alias("v"))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; NULL is empty, text with a comma is quoted."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_history_json(evals: DataFrame, path: str, columns: dict) -> None:
    """Projected and renamed evaluations as JSON lines.  columns: new name -> source column."""
    evals.select(*[col(c).alias(n) for n, c in columns.items()]).write.json(path)


def export_predictions(pred: DataFrame, path: str, columns=("grp", "unit", "seed", "split", "label", "pred")) -> None:
    pred.select(*columns, (F.col("label") == F.col("pred")).alias("correct")).write.csv(path, header=True)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below a folder; `file` is relative to the folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/").rsplit("/", 1)[-1] + "/"
    return f.select(F.substring_index("path", base, -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Every file with its state: same, changed, missing, new."""
    s = stored.select("file", F.col("bytes").alias("b0"), F.col("sha256").alias("h0"))
    c = current.select("file", F.col("bytes").alias("b1"), F.col("sha256").alias("h1"))
    j = s.join(c, "file", "full")
    state = (F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "new")
             .when((F.col("h0") == F.col("h1")) & (F.col("b0") == F.col("b1")), "same").otherwise("changed"))
    return j.select("file", state.alias("state"))
