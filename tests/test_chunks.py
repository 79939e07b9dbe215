"""Chunks by meaning against a plain walk over each document."""

import random

from pyspark.sql import functions as F

from tidewell.operators import chunks as ch
from tidewell.operators import retrieval as rt


def _plain(sentences, vectors, least, most, similarity):
    chunks, held = [], [sentences[0]]
    for i in range(1, len(sentences)):
        size = sum(len(s.encode()) for s in held) + len(held) - 1
        if ch.near(vectors[i - 1], vectors[i]) < similarity and size >= least or size + len(sentences[i].encode()) > most:
            chunks.append(" ".join(held))
            held = []
        held.append(sentences[i])
    chunks.append(" ".join(held))
    out, end = [], len(chunks)
    for n, c in enumerate(chunks):
        if len(c.encode()) <= most:
            out.append((n, c))
            continue
        part = ""
        for w in c.split():
            if part and len(part.encode()) + len(w.encode()) + 1 > most:
                out.append((end, part))
                end, part = end + 1, ""
            part = f"{part} {w}" if part else w
        out.append((end, part))
        end += 1
    return sorted(out)


def test_grouping_equals_a_plain_walk(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        n = rng.choice([2, 3, 40, 400])
        sentences = [" ".join(rng.choices(["é", "word", "longer", "x" * 15], k=rng.choice([1, 4, 9, 60]))) + "." for _ in range(n)]
        vectors = [rng.choice([[1.0, 0.0], [0.0, 1.0], [0.8, 0.6], [0.0, 0.0]]) for _ in range(n)]
        rows += [(i, k, s, v) for k, (s, v) in enumerate(zip(sentences, vectors, strict=True))]
        want[i] = _plain(sentences, vectors, 40, 150, 0.3)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, position int, sentence string, embedding array<double>")
    got = {}
    for r in ch.grouped(df, 40, 150, 0.3).collect():
        got.setdefault(r.id, []).append((r.position, r.chunk))
    assert {i: sorted(v) for i, v in got.items()} == want


def test_lost_embeddings_fall_back_to_paragraphs(spark):
    texts = [(1, "First one here. Second one here.\n\nThird para. " + "w " * 90), (2, "Only one sentence " + "long " * 60), (3, "A fine one. Another fine one."), (4, None), (5, "!!! ..."), (6, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    gap = lambda rows: rows.withColumn("embedding", F.when((F.col("id") == 1) & (F.col("position") == 1) | (F.col("id") == 2), F.lit(None)).otherwise(F.array(F.lit(1.0))))
    lost = lambda rows: gap(rows).filter("id <> 1 or position <> 0")
    for embed in (gap, lost):
        got = sorted((r.id, r.position, r.chunk) for r in ch.semantic_chunks(docs, embed, 10, 100).collect())
        paragraphs = sorted((r.id, r.position, r.chunk) for r in rt.capped_paragraphs(docs.filter("id = 1"), 100).collect())
        assert got == [*paragraphs, (2, 0, texts[1][1].strip()), (3, 0, "A fine one. Another fine one.")]


def test_sentences_are_trimmed_and_long_enough(spark):
    text = "One.\n Two is! —…— . No\r\n\r\nab.  Next one?\nlast  \n\n  \n\nÉt"
    got = [r.sentence for r in rt.sentences(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("position").collect()]
    assert got == ["One.", "Two is!", "Next one?", "last", "Ét"]


def _texts(spark):
    rng = random.Random(3)
    words = ["é", "word", "longer", "x" * 15]
    rows = [(i, " ".join(" ".join(rng.choices(words, k=rng.choice([1, 4, 9, 60]))) + ". Fine." for _ in range(rng.choice([1, 3, 40])))) for i in range(50)]
    return spark.createDataFrame([*rows, (50, "Alone here"), (51, None), (52, "..."), (53, "")], "id long, text string").repartition(3)


def _turning(rows):
    return rows.withColumn("embedding", F.array(*[(F.crc32(F.concat(F.lit(str(i)), F.col("sentence").cast("string"))) % 5).cast("double") for i in range(2)]))


def test_whole_texts_are_chunked_as_their_sentences(spark):
    """Batches of any size, embeddings that are lists of one size: the chunks of ``grouped``."""
    docs = _texts(spark)
    want = sorted(ch.grouped(_turning(rt.sentences(docs)).filter("id <> 50"), 40, 150, 0.8).collect()) + [(50, 0, "Alone here")]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", held):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted(ch.semantic_chunks(docs, _turning, 40, 150, 0.8).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_a_document_without_any_embedding_is_cut_into_paragraphs(spark):
    docs = spark.createDataFrame([(1, "One here. Two here.\n\nThree here."), (2, "Kept one. Kept two.")], "id long, text string")
    got = sorted(ch.semantic_chunks(docs, lambda rows: _turning(rows).filter("id = 2"), 100, 200).collect())
    assert got == [(1, 0, "One here. Two here."), (1, 1, "Three here."), (2, 0, "Kept one. Kept two.")]


def test_texts_are_cut_twice_and_embedded_once(spark, tmp_path):
    """Seven cuts of every text and two embeddings before; one shuffle, and no join, of what is made of them."""
    _texts(spark).write.parquet(str(tmp_path / "docs"))
    plan = ch.semantic_chunks(spark.read.parquet(str(tmp_path / "docs")), _turning, 40, 150)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?<=[.!?])|") == 2 and plan.count("crc32(") == 2  # an embedding of two numbers
    assert plan.count("Exchange") == 1 and "Join" not in plan
