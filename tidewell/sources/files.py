"""File sources and sinks: texts by lines, notebooks, logs, artifacts, and writes to several places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of the known binary kinds, in hexadecimal.
MAGIC = {"pdf": "25504446", "jpeg": "FFD8FF", "png": "89504E47", "gif": "47494638"}
NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:array<string>,outputs:array<struct<output_type:string,text:array<string>>>>>>"


def text_lines(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(path, number, line) of whole text files; ``offset`` lines are skipped in each, ``limit`` are kept."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    kept = F.slice("lines", offset + 1, limit) if limit is not None else F.slice("lines", F.lit(offset + 1), F.greatest(F.size("lines") - offset, F.lit(0)))
    return whole.select("path", F.posexplode(kept).alias("_at", "line")).select("path", (F.col("_at") + offset + 1).alias("number"), "line")


def file_kind(path: Column, content: Column) -> Column:
    """Kind of a file: by its extension, by its first bytes, else binary by a NUL or by fewer than four in
    five printable ASCII bytes or blanks among the first 512."""
    known = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    kind = F.when(known.isin("pdf", "png", "gif"), known).when(known.isin("jpg", "jpeg"), "jpeg").when(known == "ipynb", "notebook")
    for name, start in MAGIC.items():
        kind = kind.when(head.startswith(start), name)
    start = F.hex(F.substring(content, 1, 512))
    shown = F.length(F.regexp_replace(F.regexp_replace(start, "(..)", "$1 "), "(?:0[9AD]|[2-6][0-9A-F]|7[0-9A-E]) ", "."))
    # a printable byte has become one sign, any other three
    total = F.length(start) / 2
    printable = (3 * total - shown) / 2
    return kind.when(start.rlike("^(..)*?00"), "binary").when((total > 0) & (printable < 0.8 * total), "binary").otherwise("text")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, kind) of all files under a prefix; the contents stay with the readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), file_kind(F.col("path"), F.col("content")).alias("kind"))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """(path, position, kind, source, outputs) of notebooks (path, text)."""
    cells = notebooks.select("path", F.posexplode(F.from_json("text", NOTEBOOK)["cells"]).alias("position", "cell"))
    said = F.transform(F.coalesce("cell.outputs", F.array().cast("array<struct<output_type:string,text:array<string>>>")), lambda o: F.array_join(o["text"], ""))
    return cells.select("path", "position", F.col("cell.cell_type").alias("kind"), F.array_join("cell.source", "").alias("source"), F.array_join(said, "\n").alias("outputs"))


def log_tail(logs: DataFrame, n: int, secret: str = "(?i)(password|secret|token|api_?key)", most: int = 1 << 16) -> DataFrame:
    """The newest n rows of logs (offset, line), a JSON object each, lines beyond ``most`` bytes left
    out and the values of secret fields masked."""
    newest = logs.filter(F.octet_length("line") <= most).orderBy(F.desc("offset")).limit(n)
    fields = F.from_json("line", "map<string,string>")
    return newest.select("offset", F.to_json(F.transform_values(fields, lambda k, v: F.when(k.rlike(secret), "[REDACTED]").otherwise(v))).alias("line"))


CONVERTED = "struct<status:string,errors:array<string>,document:struct<md_content:string,pages:map<string,string>,pictures:array<struct<image:struct<uri:string,mimetype:string>>>>>"


def converted_documents(answers: DataFrame) -> DataFrame:
    """(id, markdown, pages, images, problem) of conversion answers (id, text): whole or partial successes,
    pictures with embedded data numbered as image_0001 and so on; the errors of the others."""
    a = F.from_json("text", CONVERTED)
    ok = F.coalesce(a["status"].isin("success", "partial_success") & a["document"].isNotNull(), F.lit(False))
    data = F.transform(F.coalesce(a["document"]["pictures"], F.array().cast("array<struct<image:struct<uri:string,mimetype:string>>>")), lambda p, i: F.struct(i.alias("at"), p["image"]["uri"].alias("uri")))
    kept = F.filter(data, lambda p: F.coalesce(p["uri"].rlike("^data:[^;]*;base64,."), F.lit(False)))
    named = F.transform(kept, lambda p: F.concat(F.format_string("image_%04d.", p["at"] + 1), F.regexp_replace(F.regexp_extract(p["uri"], "^data:[a-z]+/([a-z]+)", 1), "jpeg", "jpg")))
    problem = F.coalesce(F.nullif(F.array_join(a["errors"], "; "), F.lit("")), F.lit("unknown failure"))
    return answers.select("id", F.when(ok, a["document"]["md_content"]).alias("markdown"), F.when(ok, F.coalesce(F.size(a["document"]["pages"]), F.lit(0))).alias("pages"), F.when(ok, named).alias("images"), F.when(~ok, problem).alias("problem"))


def write_to_all(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """Hand df to every sink; it is kept between them, so its plan runs once."""
    kept = df.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def files_sink(path: str, kind: str = "json") -> Callable[[DataFrame], None]:
    return lambda df: df.write.mode("append").format(kind).save(path)
