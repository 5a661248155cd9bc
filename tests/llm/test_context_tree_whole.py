"""Every context counts, however many there are: the table way against the tree in the tasks."""

import math
import random

import numpy as np
import pytest

from corpusloom.llm import context_tree
from corpusloom.llm.context_tree import GRAM, count_corpus, learn, score_corpus, text_scores
from test_context_tree import held_out, low


@pytest.mark.parametrize("contexts, block", [(10, 1 << 23), (10, 200), (1 << 14, 1 << 23)])
def test_no_context_is_dropped(spark, table, monkeypatch, contexts, block):
    monkeypatch.setattr(context_tree, "CONTEXTS", contexts)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", block)
    rng = random.Random(4)
    texts = [None, "", "日本 é", "ab" * 40] + ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [*enumerate(texts), (None, "the null id"), (5, texts[5])]
    docs = table(rows).repartition(3)
    got = {(r.doc_id, r.n_tokens): r.score for r in score_corpus(docs, held_out).collect()}
    grams = count_corpus(docs.where(~held_out(docs.doc_id))).where(f"kind = {GRAM}").select("code", "n")
    whole = learn(grams, 10**6)
    assert len(whole.log10) > 100
    for doc_id, text in rows:
        body = np.frombuffer(low(text), np.uint8)
        want = text_scores(whole, body, np.array([0, len(body)]))[0]
        tokens = len((text or "").split()) + 1
        assert math.isclose(got[(doc_id, tokens)], want, rel_tol=1e-5, abs_tol=1e-4), doc_id
