import random
import re

from corpusloom.llm import license_index
from corpusloom.llm.license_index import scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def places(words):
    out = []
    for i in range(len(words)):
        for phrase, label in license_index.PHRASES.items():
            p = phrase.split()
            if words[i : i + len(p)] == p:
                out.append((i, label))
    return out


def test_phrases_and_words(spark, table):
    rng = random.Random(2)
    parts = ["MIT License", "mit-license", "the General  Public\nLicense", "apache", "license", "Straße", "É", "mİt license",
             "", "x1", "\x7f", "_", "general public", "日本"]
    texts = [None, "", " - ", " ".join(rng.choice(parts) for _ in range(20000))]
    texts += [rng.choice(["", " "]) + " ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = scan_licenses(table(texts, words=3, found="x")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = words_of(texts[r.doc_id])
        assert r.n_words == len(words), texts[r.doc_id]
        assert [tuple(p) for p in r.places] == places(words)


def test_notices(table):
    noise = "lorem ipsum " * 30
    texts = [
        noise + "Licensed under CC BY-NC 4.0.",
        noise + "Released under the MIT License. " + noise,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby denied to any person of this software",
        "free software foundation and the terms of a license " * 50,
        noise,
    ]
    rows = {r.doc_id: {f["label"] for f in r.found} for r in scan_licenses(table(texts)).collect()}
    assert rows == {0: {"cc-by-nc"}, 1: {"mit"}, 2: {"mit"}, 3: set(), 4: set(), 5: set()}


def test_empty(spark, table):
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = scan_licenses(table([(None, "mit license"), (None, "mit license")])).collect()
    assert [len(r.places) for r in rows] == [1, 1]
