"""Review sources and dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aspectra import lexicons as L
from aspectra.functions.ops import global_rank


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Header CSV (multi-line quoted fields) or parquet/json by extension."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    if fmt == "csv":
        return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                .option("encoding", "UTF-8").csv(path))
    return spark.read.format(fmt).load(path)


def with_row_position(df: DataFrame, out: str = "row_pos") -> DataFrame:
    """Dense 0-based row number in FILE order, without a global window.

    ``df`` is read from files.  Rows are numbered inside their file (parquet: the file's own
    row index) or inside their split of it (CSV, JSON: the order in which the scan yields
    them); row counts per file or split, in path and offset order, become offsets.  One
    window runs over these counts, one row per split.
    """
    scan = df.select("_metadata").schema["_metadata"].dataType.names
    order = ["_fp", "_bs"]
    meta = df.select("*", F.col("_metadata.file_path").alias("_fp"), *(
        [F.lit(0).alias("_bs"), F.col("_metadata.row_index").alias("_ri")] if "row_index" in scan
        else [F.col("_metadata.file_block_start").alias("_bs"), F.monotonically_increasing_id().alias("_ri")]))
    splits = meta.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"), F.min("_ri").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select(*order, F.coalesce(before, F.lit(0)).alias("_off"),
                            (F.lit(0) if "row_index" in scan else F.col("_first")).alias("_first"))
    return (meta.join(offsets, order)
            .withColumn(out, (F.col("_off") + F.col("_ri") - F.col("_first")).cast("long"))
            .drop("_ri", "_off", "_first", *order))


def reviews(df: DataFrame, text_col: str = "HIGHLIGHTED_REVIEW_CONTENT", id_col: str | None = "ORGANIZATION_ID",
            position_col: str | None = None) -> DataFrame:
    """S1 + S2: (source_id, text).  Missing text column is an error; null text -> ''.
    Without the id column the id is the 0-based row position."""
    if text_col not in df.columns:
        raise KeyError(f"Text column {text_col} is missing from input data")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if id_col and id_col in df.columns:
        return df.select(F.col(id_col).cast("string").alias("source_id"), text.alias("text"), *(
            [F.col(position_col)] if position_col else []))
    pos = with_row_position(df, "_pos") if not position_col else df.withColumn("_pos", F.col(position_col))
    return pos.select(F.col("_pos").cast("string").alias("source_id"), text.alias("text"), *(
        [F.col(position_col)] if position_col else []))


def nonnull_reviews(df: DataFrame, text_col: str = "HIGHLIGHTED_REVIEW_CONTENT", id_col: str = "ID",
                    org_col: str = "ORGANIZATION_ID") -> DataFrame:
    """S3: rows with non-null text; REVIEW_ID / ORGANIZATION_ID are null when the column is absent."""
    rid = F.col(id_col).cast("string") if id_col in df.columns else F.lit(None).cast("string")
    org = F.col(org_col).cast("string") if org_col in df.columns else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in (text_col, id_col, org_col)]
    return df.where(F.col(text_col).isNotNull()).select(
        rid.alias("REVIEW_ID"), org.alias("ORGANIZATION_ID"), F.col(text_col).alias("text"), *rest)


def keyword_mapping(df: DataFrame, order_col: str, keyword_col: str = "KEYWORD_NAME",
                    value_cols: Sequence[str] = ("KPI_ID", "KPI_NAME", "DEPARTMENT_ID", "DEPARTMENT_NAME")) -> DataFrame:
    """key = lower(trim(keyword)); for duplicate keys the LAST row's values win while the
    FIRST row's position is kept (dict-update semantics).  One aggregation; the result is
    a dimension (one row per keyword)."""
    key = F.lower(F.trim(F.col(keyword_col).cast("string")))
    vals = F.struct(*[F.col(c) for c in value_cols])
    g = df.select(key.alias("keyword"), F.col(order_col).alias("_o"), vals.alias("_v")).groupBy("keyword").agg(
        F.min("_o").alias("pos"), F.max_by("_v", "_o").alias("_v"))
    return g.select("keyword", "pos", *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def label_list(df: DataFrame | None, spark: SparkSession | None = None, defaults: Sequence[str] = (),
               order_col: str | None = None) -> DataFrame:
    """First column as string, rows with any null dropped, BOM stripped; defaults when
    no table is given."""
    if df is None:
        return spark.createDataFrame([(d, i) for i, d in enumerate(defaults)], "label string, pos long")
    first = df.columns[0]
    label = F.regexp_replace(F.col(first).cast("string"), "^\ufeff", "")
    # numbered before rows are dropped, then ranked again without gaps
    placed = with_row_position(df, "_pos") if order_col is None else df.withColumn("_pos", F.col(order_col).cast("long"))
    clean = placed.dropna(subset=df.columns).select(label.alias("label"), "_pos")
    return global_rank(clean, F.col("_pos"), "pos").select("label", (F.col("pos") - 1).alias("pos"))


def default_kpis(spark: SparkSession) -> DataFrame:
    return label_list(None, spark, L.DEFAULT_KPIS)


def default_departments(spark: SparkSession) -> DataFrame:
    return label_list(None, spark, L.DEFAULT_DEPARTMENTS)


def next_run_serial(names: DataFrame, name_col: str = "name", base: int = 4,
                    explicit: str | None = None) -> DataFrame:
    """Next serial from existing output names ``<n>_keywords.json``:
    max(existing, base-1)+1, or base when none; an explicit name overrides."""
    idx = F.regexp_extract(F.col(name_col), r"^(\d+)_keywords\.json$", 1)
    m = names.where(idx != "").agg(F.max(idx.cast("long")).alias("m"))
    nxt = F.when(F.col("m").isNull(), F.lit(base)).otherwise(F.greatest(F.col("m"), F.lit(base - 1)) + 1)
    out = m.select(nxt.cast("long").alias("next_serial"))
    name: Column = F.lit(explicit) if explicit else F.concat(F.col("next_serial").cast("string"), F.lit("_keywords.json"))
    return out.withColumn("next_name", name)
