"""Readers and writers of the file formats. Schemas are fixed; nothing is inferred but ARFF headers and TextGrid tiers.

Recordings are files; rec is the file's base name without its extension. All readers take a folder, a file or a glob.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.lineage import numbered

#: Distance that stands for an empty slot in discovery and search files.
EMPTY = 3.4028234e38

SCHEMAS = {
    "pitch": "t DOUBLE, value DOUBLE",
    "tonic": "tonic DOUBLE",
    "segments": "seg_start DOUBLE, seg_end DOUBLE",
    "motifs": "s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE, dist DOUBLE, ind1 BIGINT, ind2 BIGINT",
    "pattern_info": "id BIGINT, s_time DOUBLE, e_time DOUBLE",
    "neighbours": "id1 BIGINT, id2 BIGINT, dist DOUBLE",
    "subsequence_info": "s_time DOUBLE, duration DOUBLE, file_id INT, query_idx INT, label INT",
    "blacklist": "flag INT",
    "transcription": "s_time DOUBLE, e_time DOUBLE, level DOUBLE",
}


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of white-space separated fields: rec, line (from 0) and the fields of the format.

    Lines with too few fields, and fields that aren't numbers, raise an error.
    """
    fields = [f.split() for f in SCHEMAS[kind].split(", ")]
    lines = spark.read.text(path).select(base_name(F.col("_metadata.file_path")).alias("rec"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"), F.monotonically_increasing_id().alias("_at"))
    # Files are split in order, and rows of a split are in order: the id of a row orders the lines of a file.
    numbered = lines.where(F.trim("value") != "").withColumn("line", (F.row_number().over(W.partitionBy("rec").orderBy("_block", "_at")) - 1).cast("long"))
    parts = F.split(F.trim("value"), r"\s+")
    return numbered.select("rec", "line", *[F.element_at(parts, i).cast(kind_).alias(name) for i, (name, kind_) in enumerate(fields, 1)])


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all recordings: rec_id (the base name), idx, t, value."""
    return read_fields(spark, path, "pitch").select(F.col("rec").alias("rec_id"), F.col("line").alias("idx"), "t", "value")


def read_queries(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Query spans of four formats: rec, query, s_time, e_time.

    motifs: both sides of each pair that isn't an empty slot; annotation: start, duration, label; spans: start, end, class;
    patterns: id, start, end.
    """
    if form == "motifs":
        rows = read_fields(spark, path, "motifs").where(F.col("dist") < EMPTY)
        sides = F.posexplode(F.array(F.struct(F.col("s1").alias("s"), F.col("e1").alias("e")), F.struct(F.col("s2").alias("s"), F.col("e2").alias("e")))).alias("side", "x")
        return rows.select("rec", "line", sides).select("rec", (2 * F.col("line") + F.col("side")).alias("query"), F.col("x.s").alias("s_time"), F.col("x.e").alias("e_time"))
    lines = read_fields(spark, path, "pattern_info") if form == "patterns" else None
    if lines is not None:
        return lines.select("rec", F.col("id").alias("query"), "s_time", "e_time")
    rows = spark.read.text(path).select(base_name(F.col("_metadata.file_path")).alias("rec"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 1)
    a, b = F.get("p", F.lit(0)).cast("double"), F.get("p", F.lit(1)).cast("double")
    end = a + b if form == "annotation" else b
    if form not in ("annotation", "spans"):
        raise ValueError(f"unknown query format {form}")
    spans = rows.select("rec", a.alias("s_time"), end.alias("e_time"))
    return spans.withColumn("query", (F.row_number().over(W.partitionBy("rec").orderBy("s_time", "e_time")) - 1).cast("long")).select("rec", "query", "s_time", "e_time")


def read_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """A ``name: value`` file; a repeated name keeps its last value. Parameter files are a few lines."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return dict(re.findall(r"(?m)^\s*([^:\s]+)\s*:\s*(.*?)\s*$", text))


def read_subsequences(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Raw little-endian doubles, ``length`` a row: rec, row, data. A file whose size isn't whole rows raises an error."""

    def parse(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, blob in zip(batch.column("rec").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = np.frombuffer(blob, "<f8").reshape(-1, length)
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    yield pa.record_batch({"rec": pa.array([name] * len(part)), "row": pa.array(range(lo, lo + len(part)), pa.int64()), "data": pa.array(list(part), pa.list_(pa.float64()))})

    files = spark.read.format("binaryFile").load(path).select(base_name(F.col("path")).alias("rec"), "content")
    return files.mapInArrow(parse, "rec string, row long, data array<double>")


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Files below a folder with an extension, in any case: path, rec, length. Their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith("." + extension.lower().lstrip("."))).select("path", base_name(F.col("path")).alias("rec"), "length")


def file_presence(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """A row a base name and a total row (rec null): for each extension whether there is a file, or how many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(base_name(F.col("path")).alias("rec"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"))
    return files.rollup("rec").agg(*[F.countDistinct(F.when(F.col("ext") == e, F.col("rec"))).alias(e) for e in extensions])


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).groupBy(base_name(F.col("_metadata.file_path")).alias("rec")).agg(F.count(F.lit(1)).alias("lines"))


def write_fields(rows: DataFrame, path: str, columns: list[str], order: list[str], sep: str = "\t") -> None:
    """Rows as text fields, sorted by ``order`` within and across the files."""
    rows.orderBy(*order).select(*columns).write.mode("errorifexists").option("sep", sep).csv(path)


def wide_search(found: DataFrame, k: int) -> DataFrame:
    """Search results (query, rank, fields q_s, q_e, m_s, m_e, dist, file_id) a row a rank, six columns a query; -1 is empty."""
    fields = ["q_s", "q_e", "m_s", "m_e", "dist", "file_id"]
    names = [r["query"] for r in found.select("query").distinct().orderBy("query").collect()]
    out = found.where(F.col("rank") <= k).groupBy("rank").pivot("query", names).agg(*[F.first(f).alias(f) for f in fields])
    return out.na.fill(-1.0).orderBy("rank")


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """A table with the attributes of the header: numeric ones as doubles, nominal ones as strings."""
    text = spark.read.text(path)
    header = [r[0] for r in text.where(F.lower(F.trim("value")).startswith("@attribute")).collect()]  # a line an attribute
    names, kinds = [], []
    for line in header:
        m = re.match(r"(?i)\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$", line)
        names.append(m[1].strip("'\""))
        kinds.append("double" if re.match(r"(?i)(numeric|real|integer)", m[2]) else "string")
    body = text.where(~F.trim("value").startswith("@") & ~F.trim("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split("value", r"\s*,\s*")
    return body.select(*[F.when(F.trim(F.get(parts, F.lit(i))) != "?", F.trim(F.get(parts, F.lit(i)))).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])


def arff_lines(rows: DataFrame, label: str, relation: str = "features") -> DataFrame:
    """The lines of an ARFF table (order, value), the label last; labels are listed in order."""
    spark = rows.sparkSession
    features = [c for c in rows.columns if c != label]
    labels = [str(r[0]) for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    head = [f"@RELATION {relation}", *[f"@ATTRIBUTE {c} NUMERIC" for c in features], f"@ATTRIBUTE {label} {{{','.join(labels)}}}", "@DATA"]
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "n long, value string")
    body = rows.select(F.monotonically_increasing_id().alias("n"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in [*features, label]]).alias("value"))
    return first.unionByName(body)


_INTERVAL = re.compile(r"xmin\s*=\s*([-\d.eE]+)\s*xmax\s*=\s*([-\d.eE]+)\s*text\s*=\s*\"((?:[^\"]|\"\")*)\"")


def parse_textgrid(text: str) -> list[tuple[str, float, float, str]]:
    """Intervals of all tiers of a long-format TextGrid: tier, start, end, label."""
    out = []
    for part in re.split(r"item\s*\[\d+\]\s*:", text)[1:]:
        name = re.search(r"name\s*=\s*\"([^\"]*)\"", part)
        if 'class = "IntervalTier"' in part:
            out += [(name[1] if name else "", float(a), float(b), c.replace('""', '"')) for a, b, c in _INTERVAL.findall(part.partition("intervals [")[2] or part)]
    return out


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """rec, tier, s_time, e_time, label of all intervals."""
    kind = T.ArrayType(T.StructType([T.StructField("tier", T.StringType()), T.StructField("s_time", T.DoubleType()), T.StructField("e_time", T.DoubleType()), T.StructField("label", T.StringType())]))
    parse = F.udf(parse_textgrid, kind)  # a file at a time; an interval list is no column expression
    files = spark.read.text(path, wholetext=True).select(base_name(F.col("_metadata.file_path")).alias("rec"), "value")
    return files.select("rec", F.explode(parse("value")).alias("x")).select("rec", "x.*")


def textgrid_text(intervals: DataFrame) -> DataFrame:
    """rec and the text of a TextGrid with a tier for each of the intervals' tiers."""
    number = lambda c: c.cast("string")
    line = F.concat(F.lit('            xmin = '), number(F.col("s_time")), F.lit("\n            xmax = "), number(F.col("e_time")), F.lit('\n            text = "'), F.replace(F.col("label"), F.lit('"'), F.lit('""')), F.lit('"'))
    tiers = intervals.groupBy("rec", "tier").agg(F.sort_array(F.collect_list(F.struct("s_time", line.alias("line")))).alias("x"), F.min("s_time").alias("lo"), F.max("e_time").alias("hi"))
    body = F.array_join(F.transform("x", lambda v, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n"), v["line"])), "\n")
    tier = F.concat(F.lit('class = "IntervalTier"\n        name = "'), F.col("tier"), F.lit('"\n        xmin = '), number(F.col("lo")), F.lit("\n        xmax = "), number(F.col("hi")), F.lit("\n        intervals: size = "), F.size("x").cast("string"), F.lit("\n"), body)
    files = tiers.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("tier", tier.alias("text")))).alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    items = F.array_join(F.transform("t", lambda v, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit("]:\n        "), v["text"])), "\n")
    return files.select("rec", F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = '), number(F.col("lo")), F.lit("\nxmax = "), number(F.col("hi")), F.lit("\ntiers? <exists>\nsize = "), F.size("t").cast("string"), F.lit("\nitem []:\n"), items, F.lit("\n")).alias("text"))


def pajek_lines(edges: DataFrame) -> DataFrame:
    """Lines of a Pajek graph (section, n, value): vertices numbered from 1 in order of the nodes, then edges."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = numbered(nodes, "n", "node").withColumn("n", (F.col("n") + 1).cast("long"))
    count = ids.agg(F.concat(F.lit("*Vertices "), F.count(F.lit(1)).cast("string")).alias("value")).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("n"), "value")
    vertices = ids.select(F.lit(1).alias("section"), "n", F.concat(F.col("n").cast("string"), F.lit(' "'), F.col("node").cast("string"), F.lit('"')).alias("value"))
    mark = edges.sparkSession.createDataFrame([(2, 0, "*Edges")], "section int, n long, value string")
    weight = F.col("weight").cast("string") if "weight" in edges.columns else F.lit("1.0")
    named = edges.select("a", "b", weight.alias("w")).join(ids.select(F.col("node").alias("a"), F.col("n").alias("i")), "a").join(ids.select(F.col("node").alias("b"), F.col("n").alias("j")), "b")
    links = named.select(F.lit(3).alias("section"), F.col("i").alias("n"), F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("w")).alias("value"))
    return count.unionByName(vertices).unionByName(mark).unionByName(links)
