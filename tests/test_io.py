import gzip
import json

import pandas as pd
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import corpus, mentions
from corpusloom.sources import readers, writers
from corpusloom.streaming import text_stream


def test_encodings_and_newlines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Chapter 1 été\r\nx".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("Chapter 1 été".encode("latin-1"))
    (tmp_path / "c.md").write_text("skip")
    got = {r.file_name: r.text for r in readers.read_books(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Chapter 1 été\nx", "b.txt": "Chapter 1 été"}


def test_book_to_csv_and_back(spark, tmp_path):
    book = 'Chapter 1 Frodo said "hi, there". He left.\nChapter 2 Moria, dark. Nothing else.'
    df = spark.createDataFrame([(1, book)], "doc_id long, text string")
    rows = corpus.process_sentences(corpus.split_sentences(corpus.split_chapters(df)))
    tagged = mentions.joined_mentions(mentions.keep_mentioned(mentions.tag_mentions(rows, "sentence")))
    tagged = tagged.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))
    assert tagged.count() == 2
    path = str(tmp_path / "out")
    writers.write_chapter_csv(tagged.select("chapter_no", *schemas.EMBEDDED.names), path)
    back = readers.read_chapter_folder(spark, path, schemas.EMBEDDED).orderBy("chapter_no").collect()
    assert [(r.chapter_no, r.sentence, r.tokens, r.character, r.place) for r in back] == [
        (1, 'Frodo said "hi, there".', "frodo said hi", "frodo", None),
        (2, "Moria, dark.", "moria dark", None, "moria"),
    ]
    assert json.loads(back[0].embedding) == [1.0, 0.5]


def test_csv_written_by_pandas(spark, tmp_path):
    frame = pd.DataFrame({"sentence_id": [0, 1], "sentence": ['a "b", c\nd', "e"], "cleaned_sentence": ["a b c d", "e"], "tokens": ["b c", None]})
    frame.to_csv(tmp_path / "processed_chapter_7.csv", index=False)
    frame.to_csv(tmp_path / "other_7.csv", index=False)
    rows = readers.read_csv_files(spark, str(tmp_path), prefix="processed_")
    got = rows.withColumn("chapter", readers.chapter_of_file(F.col("file_name"))).orderBy("sentence_id").collect()
    assert [(r.chapter, r.sentence, r.tokens) for r in got] == [("7", 'a "b", c\nd', "b c"), ("7", "e", None)]


def test_bad_vectors_are_counted(spark, tmp_path):
    schema = "sentence string, embedding string"
    pd.DataFrame({"sentence": ["a", "b", None], "embedding": ["[1, 2]", "[1 2]", "oops"]}).to_csv(tmp_path / "e.csv", index=False)
    from pyspark.sql.types import StructType

    rows = readers.read_embedded_csv(spark, str(tmp_path), StructType.fromDDL(schema))
    got = {r.sentence: r.embedding for r in rows.collect()}
    assert got == {"a": [1.0, 2.0], "b": [1.0, 2.0], "": None}
    raw = spark.createDataFrame([("[1]", [1.0]), ("x", None), (None, None)], "t string, v array<double>")
    assert readers.bad_vectors(raw, "t", "v").first().n_bad == 1


def test_gzipped_paragraphs(spark, tmp_path):
    with gzip.open(tmp_path / "w.jsonl.gz", "wt", encoding="utf8") as f:
        f.write(json.dumps({"id": 1, "paragraphs": ["first", "second"]}) + "\n" + json.dumps({"paragraphs": []}) + "\n")
    got = [r.text for r in readers.read_paragraphs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [None, "first"]


def test_operators_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("Frodo and Frodo",), ("Moria frodo",)], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = text_stream.read_text_stream(spark, str(tmp_path / "in"), rows.schema)
    tagged = mentions.keep_mentioned(mentions.tag_mentions(stream, "text"))
    for name, df, mode in [("tf", text_stream.running_term_frequency(stream), "complete"), ("tags", tagged, "append")]:
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert {r.word: r.frequency for r in spark.table("tf").collect()} == {"frodo": 3, "moria": 1}
    assert spark.table("tags").count() == 2
