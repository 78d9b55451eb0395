"""Readers of the domain's text formats into typed tables. All take paths that Spark can read, and parse in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_header, nan_to_null, safe_ln
from .json_arrays import read_records, record_texts

_LIST = "array<double>"


def parse_list(text: Column) -> Column:
    """A bracketed list of numbers; null if any element is not one (nan included)."""
    return F.from_json(F.regexp_replace(text, r"\s+", ""), _LIST)


def parse_decimals(text: Column) -> Column:
    """The same with exact decimals, for tests of equality."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("decimal(18,6)"))


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A headed CSV or TSV with all columns as text; without `sep`, tab if the first line holds one. Header blanks are stripped."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = "\t" if first and "\t" in first[0][0] else ","
    raw = spark.read.csv(path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.toDF(*[c.strip() for c in raw.columns])


def resolve_alias(columns: list[str], aliases: list[str]) -> str:
    """The first alias that is a column, whatever its case; an error that lists the columns otherwise."""
    by_lower = {c.lower(): c for c in columns}
    for a in aliases:
        if a.lower() in by_lower:
            return by_lower[a.lower()]
    raise ValueError(f"none of {aliases} among {columns}")


def neq_table(spark: SparkSession, path: str, max_len: int = 1024, log: bool = False, sep: str = ",") -> DataFrame:
    """(name if there is one, sequence, neq): rows with a clean list as long as the sequence, at most max_len."""
    raw = delimited(spark, path, sep).dropna(subset=["sequence", "neq"])
    neq = parse_list(F.col("neq"))
    t = raw.withColumn("neq", F.transform(neq, safe_ln) if log else neq).where("neq is not null")
    return t.where((F.length("sequence") == F.size("neq")) & (F.length("sequence") <= max_len))


def neq_long(spark: SparkSession, path: str, threshold: float | None = None) -> DataFrame:
    """(name, res_idx from 1, aa, neq[, label]): one row a residue, truncated to the shorter of sequence and list.

    The name column may go by several names; a list may be bracketed or bare, a
    single number counts as a list of one.
    """
    raw = delimited(spark, path)
    try:
        name = resolve_alias(raw.columns, ["name", "id", "protein", "domain", "sequence_name"])
    except ValueError:
        name = raw.columns[0]
    text = F.regexp_replace(F.col("neq"), r"[\[\]\s]", "")
    values = F.transform(F.split(text, ","), lambda x: nan_to_null(x.try_cast("double")))
    t = raw.select(F.col(name).alias("name"), "sequence", values.alias("v")).where("name is not null and sequence is not null and v is not null")
    rows = t.select("name", "sequence", F.posexplode(F.slice("v", 1, F.least(F.length("sequence"), F.size("v")))).alias("p", "neq"))
    out = rows.select("name", (F.col("p") + 1).alias("res_idx"), F.substring("sequence", F.col("p") + 1, F.lit(1)).alias("aa"), "neq")
    return out if threshold is None else out.withColumn("label", (F.col("neq") > threshold).cast("int"))


def annotations(spark: SparkSession, path: str, known: DataFrame | None = None, by_position: bool = False) -> DataFrame:
    """Residue annotations, one row a residue, as typed columns; only ids of `known` (name) if given.

    by_position: the first and sixth columns are taken as id and class, whatever their names.
    """
    raw = delimited(spark, path)
    if by_position:
        t = raw.select(clean_header(F.col(raw.columns[0])).alias("name"), F.col(raw.columns[5]).alias("q3"), F.monotonically_increasing_id().alias("ord"))
    else:
        numbers = {"n": "int", "rsa": "double", "asa": "double", "phi": "double", "psi": "double", "disorder": "double"}
        t = raw.select(clean_header(F.col("id")).alias("name"), *[F.col(c).try_cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in raw.columns if c != "id"])
    return t if known is None else t.join(known.select("name").distinct(), "name", "left_semi")


def annotation_arrays(long: DataFrame, columns: list[str], order: str = "n") -> DataFrame:
    """Parallel arrays by name, in order of position."""
    g = long.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_r"))
    return g.select("name", *[F.col("_r").getField(c).alias(c) for c in columns])


def rmsf_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, rmsf); rows whose list does not parse are left out."""
    t = delimited(spark, path, "\t")
    for c in ("sequence_name", "sequence", "avg_per_residue_rmsf"):
        resolve_alias(t.columns, [c])
    return t.select(F.col("sequence_name").alias("name"), "sequence", parse_list(F.col("avg_per_residue_rmsf")).alias("rmsf")).where("rmsf is not null")


ATTENTION_SCHEMA = "name string, sequence string, attention_weights array<array<double>>, neq_preds array<double>, ss_pred array<string>"


def attention_records(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Records of a JSON array with a matrix; without `tolerant`, a record that lacks name or matrix is an error."""
    t = read_records(spark, path, ATTENTION_SCHEMA)
    missing = F.col("name").isNull() | F.col("attention_weights").isNull()
    if tolerant:
        return t.where(~missing).withColumn("sequence", F.coalesce("sequence", F.lit("")))
    return t.withColumn("name", F.when(missing, F.raise_error(F.lit("record without name or matrix"))).otherwise(F.col("name")))


INTERPRO_SCHEMA = (
    "struct<sequence:string,md5:string,xref:array<struct<id:string,name:string>>,matches:array<struct<locations:array<struct<start:int,`end`:int,"
    "sites:array<struct<description:string,siteLocations:array<struct<start:int,`end`:int,residue:string>>>>>>>>>"
)


def _results(spark: SparkSession, path: str) -> DataFrame:
    t = record_texts(spark, path, depth=2).select(F.from_json("text", INTERPRO_SCHEMA).alias("r"))  # an object with the array of results
    first = F.try_element_at("r.xref", F.lit(1)).getField("id")
    return t.select(first.alias("xref"), F.coalesce(first, "r.md5").alias("name"), F.explode_outer("r.matches").alias("m")).select("xref", "name", F.explode_outer("m.locations").alias("loc"))


def interpro_sites(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, start, end, i from 0, expected): a row a site position; a missing end is the start. md5 names entries without xref."""
    s = _results(spark, path).select("name", F.explode("loc.sites").alias("s")).select("name", F.col("s.description").alias("description"), F.explode("s.siteLocations").alias("p"))
    end = F.coalesce("p.end", "p.start")
    rows = s.select("name", "description", F.col("p.start").alias("start"), end.alias("end"), F.col("p.residue").alias("expected")).where("start is not null")
    return rows.withColumn("i", F.explode(F.sequence(F.col("start") - 1, F.greatest(F.col("end"), F.col("start")) - 1)))


def interpro_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end) of match locations, from 1 and inclusive; entries without xref are left out."""
    t = _results(spark, path).where("xref is not null and loc is not null")
    return t.select("name", F.col("loc.start").alias("start"), F.coalesce("loc.end", "loc.start").alias("end")).where("start is not null").distinct()


def interpro_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, i from 0) of a CSV or TSV that gives ranges or single positions under one of several column names."""
    t = delimited(spark, path)
    name = resolve_alias(t.columns, ["name", "id", "protein", "accession", "sequence_name"])
    try:
        start, end = resolve_alias(t.columns, ["start", "begin", "from"]), resolve_alias(t.columns, ["end", "stop", "to"])
    except ValueError:
        start = end = resolve_alias(t.columns, ["position", "pos", "residue", "res_idx"])
    rows = t.select(F.col(name).alias("name"), F.col(start).try_cast("int").alias("s"), F.coalesce(F.col(end).try_cast("int"), F.col(start).try_cast("int")).alias("e"))
    return rows.where("s is not null and e >= s").select("name", F.explode(F.sequence(F.col("s") - 1, F.col("e") - 1)).alias("i")).distinct()


def functional_positions(spark: SparkSession, path: str) -> DataFrame:
    """(name, i) by the file's extension: JSON sites, or a table."""
    if path.lower().endswith((".tsv", ".csv")):
        return interpro_table(spark, path)
    return interpro_sites(spark, path).select("name", "i").distinct()


def fasta(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """(id, sequence): records split at '>', wrapped lines joined, blank lines ignored."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    head = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    t = raw.select(head.alias("id"), body.alias("sequence"))
    return t.withColumn("id", F.split("id", r"\s+")[0]) if first_token else t


def run_directory(spark: SparkSession, pattern: str, runs: tuple[str, ...] = ("Neq_R1", "Neq_R2", "Neq_R3")) -> DataFrame:
    """(name, aa, neq) of per-protein TSV files: the id is the name before _Neq of the file, or of the folder that Spark wrote it to; neq the mean of its runs."""
    t = spark.read.csv(pattern, sep="\t", header=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)_Neq\.tsv(?:/[^/]*)?$", 1)
    mean = sum((F.col(c).cast("double") for c in runs), F.lit(0.0)) / len(runs)
    return t.select(F.url_decode(name).alias("name"), F.col(t.columns[0]).alias("aa"), mean.alias("neq"))


def replica_mean(frames: DataFrame) -> DataFrame:
    """(domain, temp, i, neq) from replicas of it; a null value in one replica doesn't count."""
    return frames.groupBy("domain", "temp", "i").agg(F.avg("neq").alias("neq"))


def neq_from_counts(counts: DataFrame) -> DataFrame:
    """(domain, temp, i, neq) from structural-letter counts (…, letter, n): exp of the entropy of the letter frequencies."""
    total = counts.groupBy("domain", "temp", "i").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.ln(F.col("n").cast("double"))).otherwise(0.0)).alias("s"))
    return total.where("t > 0").select("domain", "temp", "i", F.exp(F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t")).alias("neq"))


def per_temperature(wide: DataFrame, temps: list[int]) -> DataFrame:
    """(domain, sequence, temp, neq) of a table with a column neq_T a temperature; missing lists are left out."""
    long = wide.unpivot(["domain", "sequence"], [f"neq_{t}" for t in temps], "column", "neq")
    return long.select("domain", "sequence", F.regexp_extract("column", r"(\d+)$", 1).cast("int").alias("temp"), "neq").where("neq is not null")


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose list texts hold no nan, in any case."""
    for c in columns:
        df = df.where(~F.lower(F.col(c)).contains("nan"))
    return df
