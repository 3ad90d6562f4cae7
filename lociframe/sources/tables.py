"""Delimited inputs: sample sheet, contigs, coverage, calls, frequencies, traits, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe import schemas
from lociframe.fixed_values import TRAIT_COLUMNS
from lociframe.functions.text import clean_label, in_scope
from lociframe.sources.lines import read_lines, read_ordered_lines


def fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Add `f`, the fields of each line."""
    return lines.withColumn("f", F.split("value", sep))


def at(i: int) -> Column:
    return F.get("f", i)


def clean_sample_sheet(sheet: DataFrame, from_stage: int | None = None) -> DataFrame:
    """Fill the defaults: names from the id, folders from the inputs, stage from argument, column, else 1.

    Rows without an id or an input folder get `problem`; check with `valid_samples`.
    """

    def given(name: str) -> Column:
        return F.nullif(F.trim(name), F.lit(""))

    stage = F.lit(from_stage).cast("int") if from_stage is not None else F.lit(None).cast("int")
    rows = sheet.select(
        given("sample_id").alias("sample_id"),
        given("fastq_dir").alias("fastq_dir"),
        given("age").try_cast("double").alias("age"),
        F.coalesce(given("output_name"), F.lower(given("sample_id"))).alias("output_name"),
        given("work_dir").alias("work_dir"),
        given("pub_dir").alias("pub_dir"),
        F.coalesce(stage, given("from_stage").try_cast("int"), F.lit(1)).alias("from_stage"),
        given("sex").alias("sex"),
        given("notes").alias("notes"),
    )
    return rows.withColumns(
        {
            "work_dir": F.coalesce("work_dir", F.concat_ws("/", F.lit("work"), "sample_id")),
            "pub_dir": F.coalesce("pub_dir", F.concat_ws("/", F.lit("public"), "output_name")),
            "problem": F.when(F.col("sample_id").isNull(), "empty sample_id").when(
                F.col("fastq_dir").isNull(), "empty fastq_dir"
            ),
        }
    )


def valid_samples(cleaned: DataFrame) -> DataFrame:
    """Fail the job on a row with a problem."""
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")).otherwise(F.col("sample_id"))
    return cleaned.withColumn("sample_id", checked).drop("problem")


def read_sample_sheet(spark: SparkSession, path: str, from_stage: int | None = None) -> DataFrame:
    """Tab-separated sheet with a header; short rows are filled with nulls."""
    raw = spark.read.schema(schemas.SAMPLE_SHEET_TEXT).csv(path, sep="\t", header=True, mode="PERMISSIVE", enforceSchema=True)
    return clean_sample_sheet(raw, from_stage)


def parse_contigs(lines: DataFrame) -> DataFrame:
    """chrom, length of the numbered chromosomes and X."""
    return fields(lines).select(at(0).alias("chrom"), at(1).try_cast("long").alias("length")).where(in_scope(F.col("chrom")))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    return parse_contigs(spark.read.text(path))


def parse_coverage(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """chrom, start, end, bases, depth; lines with fewer than four columns or without length are dropped."""
    rows = fields(lines).where(F.size("f") >= 4).select(
        *keys,
        at(0).alias("chrom"),
        at(1).try_cast("long").alias("start"),
        at(2).try_cast("long").alias("end"),
        at(3).try_cast("long").alias("bases"),
    )
    return rows.where(F.col("bases").isNotNull() & (F.col("end") > F.col("start"))).withColumn(
        "depth", F.col("bases") / (F.col("end") - F.col("start"))
    )


def read_coverage(spark: SparkSession, path: str | Sequence[str], sample: Column | None = None) -> DataFrame:
    """Coverage files; without `sample` the id is the file name up to the first dot."""
    raw = spark.read.text(path if isinstance(path, str) else list(path))
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return parse_coverage(raw.select((stem if sample is None else sample).alias("sample_id"), "value"), ["sample_id"])


def number_list(text: Column) -> Column:
    """Comma list → doubles; unreadable entries become null."""
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def project_calls(lines: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Calls out of CHROM POS REF ALT RAF GT GP lines. GP is null when any entry is unreadable."""
    gp = number_list(at(6))
    return fields(lines).where(F.size("f") >= 6).select(
        *keys,
        "ord",
        at(0).alias("chrom"),
        at(1).try_cast("long").alias("pos"),
        at(2).alias("ref"),
        F.split(at(3), ",").alias("alt"),
        number_list(at(4)).alias("raf"),
        at(5).alias("gt"),
        F.when(F.forall(gp, lambda x: x.isNotNull()), gp).alias("gp"),
    )


def read_calls(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Query-text files, one per sample and part; the sample is the file name up to the first dot."""
    lines = read_ordered_lines(spark, path)
    stem = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    return project_calls(lines.withColumn("sample_id", stem))


def parse_panel_af(lines: DataFrame) -> DataFrame:
    """chrom, pos, af (first of the list, '.' is null), ord."""
    return fields(lines).where(F.size("f") >= 3).select(
        "ord", at(0).alias("chrom"), at(1).try_cast("long").alias("pos"), F.split(at(2), ",")[0].try_cast("double").alias("af")
    )


def read_panel_af(spark: SparkSession, path: str) -> DataFrame:
    return parse_panel_af(read_ordered_lines(spark, path))


def parse_ref_f(lines: DataFrame) -> DataFrame:
    """Fifth column of a whitespace table with a header; short rows are dropped."""
    rows = lines.withColumn("f", F.split(F.trim("value"), r"\s+")).where((F.size("f") > 4) & (F.col("ord") > 0))
    return rows.select(at(0).alias("ref_id"), at(4).try_cast("double").alias("f_value")).where(F.col("f_value").isNotNull())


def read_ref_f(spark: SparkSession, path: str) -> DataFrame:
    return parse_ref_f(read_lines(spark, path))


def parse_matrix(lines: DataFrame) -> DataFrame:
    """snp_idx (line number), p (all numbers of the line)."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    return lines.where(F.trim("value") != "").select(F.col("ord").alias("snp_idx"), numbers.alias("p"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return parse_matrix(read_lines(spark, path))


def parse_cluster_labels(lines: DataFrame) -> DataFrame:
    """label (third field), ord."""
    rows = lines.withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.size("f") >= 3)
    return rows.select(at(2).alias("label"), "ord")


def melt_traits(wide: DataFrame, columns: Sequence[str] = tuple(TRAIT_COLUMNS), name: str = "Breed") -> DataFrame:
    """breed_name, trait, value; only columns the table has, empty values dropped."""
    present = [c for c in columns if c in wide.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("trait"), F.col(f"`{c}`").cast("string").alias("value")) for c in present])
    long = wide.select(clean_label(F.col(name)).alias("breed_name"), F.explode(pairs).alias("x"))
    value = clean_label(F.col("x.value"))
    return long.select("breed_name", F.col("x.trait").alias("trait"), value.alias("value")).where(F.col("value") != "")


def read_traits(spark: SparkSession, path: str, columns: Sequence[str] = tuple(TRAIT_COLUMNS)) -> DataFrame:
    return melt_traits(spark.read.csv(path, header=True), columns)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Two-column code table: code, name."""
    return spark.read.schema("code string, name string").csv(path, header=True)


def parse_chunks(lines: DataFrame) -> DataFrame:
    """chrom, chunk_id, ireg, oreg, chunk_key."""
    return fields(lines).where(F.size("f") >= 4).select(
        at(1).alias("chrom"),
        at(0).try_cast("int").alias("chunk_id"),
        at(2).alias("ireg"),
        at(3).alias("oreg"),
        F.concat(at(1), F.lit("_chunk"), at(0)).alias("chunk_key"),
    )


def read_chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_chunks(spark.read.text(path if isinstance(path, str) else list(path)))


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("chunk_key")).where(F.col("chunk_key") != "")


def version_key(name: Column) -> Column:
    """Sort key that compares runs of digits by value: each has its number of significant digits in front of it."""
    pieces = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(p, F.lit("0")))).otherwise(p)), "")


def union_lanes(spark: SparkSession, folder: str, mate: int) -> DataFrame:
    """Lines of all lanes of one mate with the lane file and its place in version order; fails without files."""
    return with_lane_order(spark.read.text(f"{folder}/*_R{mate}_*").select(F.col("_metadata.file_name").alias("lane"), "value"))


def with_lane_order(rows: DataFrame, lane: str = "lane") -> DataFrame:
    """Number the lanes in version order. There are at most a few dozen lane files."""
    names = rows.select(lane).distinct()
    listed = names.agg(F.array_sort(F.collect_list(F.struct(version_key(F.col(lane)).alias("k"), F.col(lane).alias("l")))).alias("_l"))
    numbered = listed.select(F.posexplode("_l").alias("lane_no", "_x")).select("lane_no", F.col("_x.l").alias(lane))
    return rows.join(numbered, lane)
