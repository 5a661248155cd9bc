import hashlib
import random
import re
import string

from corpusloom.llm import secret_battery
from corpusloom.llm.secret_battery import find_secrets

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            fine = {
                "assign": lambda: len(m[2]) >= 6,
                "access": lambda: len(m[0]) >= 20,
                "hex": lambda: len(m[0]) >= 24,
            }[kind]()
            if fine:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, table):
    rng = random.Random(3)
    parts = ["token=token:abcdefg", "PassWord: 'abc", 'api_key = "0123456789"', "AKIA" + "Q7" * 8, "AKIAAKIA12",
             "0123456789abcdef01234567", "deadbeef", "ſecret=abcdefgh", "𝒳é secret==x1y2z3", "apikey:\tabcdefg",
             "AKIA" + "A" * 40, "a" * 30, " ", "\n", "\x01", "é", "x", "secret=ab token=abcdefgh"]
    texts = [None, "", "".join(rng.choice(parts) for _ in range(4000))]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = find_secrets(table(texts, spans=1, base="x")).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [tuple(s) for s in r.spans if s["rank"] < 3]
        assert base == brute(texts[r.doc_id]), r.doc_id


def test_random_strings(table):
    rng = random.Random(5)
    full = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(full) for _ in range(n)) for n in [24, 32, 40, 64] * 5]
    keys = [k for k in keys if re.search("[0-9]", k)]
    plain = ["Aa1" * 20, "Abcdefghijklmnopqrstuvwxyz0123", "https/Www/example/Path/Page1/index/page/Page2", "Word7word7word7word7word7"]
    got = find_secrets(table([f"here {k} there" for k in keys + plain])).collect()
    hits = {r.doc_id for r in got if any(s["kind"] == "random" for s in r.spans)}
    assert len(hits & set(range(len(keys)))) >= 0.9 * len(keys)
    assert not hits & set(range(len(keys), len(keys) + len(plain)))


def test_null_ids_and_empty(spark, table):
    assert find_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = find_secrets(table([(None, "token=abcdef"), (None, "token=abcdef"), (4, None)])).collect()
    assert sorted((r.doc_id or -1, len(r.spans)) for r in rows) == [(-1, 1), (-1, 1), (4, 0)]


def test_false_discovery_histogram(spark):
    """Against the textbook procedure on the cells' own p-values."""
    import math

    rng = random.Random(7)
    rows = [(rng.randint(4, 6), min(440, int(rng.expovariate(0.02)))) for _ in range(4000)]
    got = {r.octave: r.first_rejected for r in secret_battery.rejection_cells(spark.createDataFrame(rows, "octave int, cell int")).collect()}
    for octave in (4, 5, 6):
        p = sorted(math.exp(-c / secret_battery.P_STEPS) for o, c in rows if o == octave)
        cut = max((x for i, x in enumerate(p, 1) if x <= secret_battery.Q * i / len(p)), default=0)
        for o, c in rows:
            if o == octave:
                assert (c >= got[octave]) == (math.exp(-c / secret_battery.P_STEPS) <= cut + 1e-15)


def test_query_digest(spark, tmp_path, table):
    from corpusloom.llm.queries import op7_secrets

    texts = ["token=abcdefgh and 0123456789abcdef0123456789", None]
    table(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op7_secrets(spark, str(tmp_path)).collect()}
    assert (rows[0].n_assign, rows[0].n_access, rows[0].n_hex) == (1, 0, 1)
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(texts[0]))
    assert rows[0].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
