import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leadspark.llm.secret_scan import ENCODINGS, ORDINARY, SYMBOLS, _battery, redact_secrets, scan_secrets, word_model
from tests.llm.fixtures import awkward_docs, empty_docs

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def rows():
    rnd = random.Random(1)
    pick = lambda s, n: "".join(rnd.choice(s) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = [
        "Password: secret: abcdefghij and token=12345678",
        "😀 é API_KEY = 'abcDEF123456' apikey:short AKIA" + pick("ABC123", 16),
        "AKIA123 AKIAAKIA" + pick("XYZ0", 12) + " " + pick("0123456789abcdef", 40) + "g" + pick("0123456789abcdef", 31),
        'secret="' + pick("0123456789abcdef", 64) + '"',
        "see " + pick(b64, 60) + " here",
        "an extraordinarilylongcompoundwordthatisnotasecretatall and zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz",
        " ".join("token=" + pick(b64, 12) for _ in range(300)),
    ]
    return out


def test_base_spans_and_extra_ones(spark):
    texts = rows()
    docs = awkward_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = scan_secrets(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kinds = ("assign", "access", "hex")
    for r in got:
        want = brute(by_id[r["doc_id"]])
        line = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[1005] == ""


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a token=12345678 b", 18), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redact_secrets(docs).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: (None, 0), 3: ("clean", 5)}


def test_empty_table(spark):
    assert scan_secrets(empty_docs(spark)).collect() == []
    assert redact_secrets(empty_docs(spark)).collect() == []


def prose(rnd):
    pieces = "ation ing ent er the con pro ment al is ten ver min ter ly ous re de un in com per for able".split()
    word = lambda k: "".join(rnd.choice(pieces) for _ in range(k))
    text = [word(rnd.randrange(1, 5)) for _ in range(60)]
    for _ in range(3):
        long = rnd.choice([word(rnd.randrange(7, 14)), "/".join(word(2) for _ in range(4)), "_".join([word(2).title(), word(3), str(rnd.randrange(2100)), word(2)]), "-".join(word(2) for _ in range(5))])
        text.insert(rnd.randrange(len(text)), long)
    return text


def test_planted_keys_are_found_and_words_are_not(spark):
    rnd = random.Random(3)
    alphabets = ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", SYMBOLS[:62], SYMBOLS[:64]]
    rows, planted = [], {}
    for i in range(2500):
        text = prose(rnd)
        if i % 4 == 0:
            kind, n = (i // 4) % 5, rnd.choice([24, 32, 40, 64])
            key = "".join(rnd.choice(alphabets[kind]) for _ in range(n))
            at = rnd.randrange(len(text))
            text.insert(at, key)
            planted[i] = (kind, n, len(" ".join(text[:at])) + (at > 0))
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = {}
    for i, (kind, n, at) in planted.items():
        mark = f"random:{at}:{at + n}"
        hits.setdefault((kind, n), []).append(mark in got[i])
        got[i].discard(mark)
    assert all(sum(h) >= 0.9 * len(h) for h in hits.values()), {k: sum(h) / len(h) for k, h in hits.items()}
    assert sum(map(len, got.values())) <= 0.01 * len(planted)


def plain_battery(token, model):
    n = len(token)
    e = next(k for k, (pattern, _, _) in enumerate(ENCODINGS) if re.search(pattern, token))
    _, alphabet, split = ENCODINGS[e]
    size, pairs = len(alphabet), n * (n - 1) / 2
    tail = lambda z: -z * z / 2 - math.log(2) if z < 0 else 0.0
    equal = sum(token.count(c) * (token.count(c) - 1) / 2 for c in alphabet)
    r = model.repeat[e]
    p = tail((equal - pairs * r) / math.sqrt(pairs * r * (1 - r) * (1 + 2 * r * n / 10)))
    side = [alphabet.index(c) < split for c in token]
    ones, turns = sum(side), sum(a != b for a, b in zip(side, side[1:], strict=False))
    mean = 2 * ones * (n - ones) / n
    runs_z = (turns - mean) / math.sqrt(max(0.25, mean * (mean - 1) / (n - 1)))
    seen, rate = turns / (n - 1), model.turn[e]
    if seen > rate:
        p -= (n - 1) * (seen * math.log(seen / rate) + ((1 - seen) * math.log((1 - seen) / (1 - rate)) if seen < 1 else 0))
    codes = [alphabet.index(c) + 1 - (size + 1) / 2 for c in token]
    drift = sum(codes) ** 2 / n
    power = sum(c * c for c in codes) - drift
    serial = ((sum(a * b for a, b in zip(codes, codes[1:], strict=False)) - drift) / power if power > 0 else 1.0) * math.sqrt(n)
    at = [SYMBOLS.index(c) for c in token]
    likely = sum(model.log[a, b] for a, b in zip(at, at[1:], strict=False))
    p += tail((likely - (n - 1) * model.mean[e]) / (model.spread[e] * math.sqrt(2 * (n - 1))))
    ordinary = abs(runs_z) <= ORDINARY and abs(serial) <= ORDINARY and equal <= pairs / size + ORDINARY * math.sqrt(pairs / size) + 1
    return min(13, math.floor(2 * math.log2(n / 20))), max(-60.0, min(0.0, 1 + p / 3)), ordinary


def test_whole_result_equals_plain_python(spark):
    """Tokens, p-values and the step-up rule of every band, without Spark."""
    rnd = random.Random(13)
    rows = []
    for i in range(400):
        text = prose(rnd)
        if i % 3 == 0:
            text.insert(5, "".join(rnd.choice(SYMBOLS[:62]) for _ in range(rnd.choice([20, 26, 40]))))
        if i % 7 == 0:
            text.insert(2, "token=" + "".join(rnd.choice(SYMBOLS[:62]) for _ in range(30)))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, tested = word_model(docs), []
    for i, text in rows:
        base = brute(text)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if not any(a < m.end() and m.start() < b for a, _, b in base):
                tested.append((i, m.start(), m.end(), *plain_battery(m[0], model)))
    step = lambda p: math.ceil(round(p, 6) / 0.05)
    limit = {}
    for band in {t[3] for t in tested}:
        mine = [t for t in tested if t[3] == band]
        for t in mine:
            below = sum(u[5] and step(u[4]) <= step(t[4]) for u in mine)
            if t[5] and math.exp(step(t[4]) * 0.05) * len(mine) <= 0.01 * below:
                limit[band] = max(limit.get(band, -(10**9)), step(t[4]))
    want = {(i, f"random:{a}:{b}") for i, a, b, band, p, ordinary in tested if ordinary and step(p) <= limit.get(band, -(10**9))}
    got = {(r["doc_id"], s) for r in scan_secrets(docs).collect() for s in r["spans"].split(",") if s.startswith("random")}
    assert got == want and len(want) > 100


def test_battery_equals_plain_python(spark):
    rnd = random.Random(7)
    model = word_model(spark.createDataFrame([(1, " ".join(" ".join(prose(rnd)) for _ in range(20)))], "doc_id long, text string"))
    tokens = ["a" * 20, "0123456789" * 3, "=" * 25, "ab" * 30]
    for _ in range(150):
        _, alphabet, _ = rnd.choice(ENCODINGS)
        tokens.append("".join(rnd.choice(alphabet[: rnd.randrange(2, len(alphabet) + 1)]) for _ in range(rnd.randrange(20, 90))))
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.transform(F.array("t"), lambda t: _battery(t, model))[0].alias("b")).collect()
    for r in rows:
        band, p, ordinary = plain_battery(r["t"], model)
        assert (r["b"]["band"], r["b"]["ordinary"]) == (band, ordinary) and r["b"]["p"] == pytest.approx(p, abs=1e-5), r["t"]


def test_other_columns_survive_redaction_whatever_their_names(spark):
    docs = spark.createDataFrame([(None, "a token=12345678 b", "x", "y", 3), (1, None, "x", "y", 3)], "doc_id long, text string, _base string, row string, _t int")
    assert [tuple(r) for r in redact_secrets(docs).orderBy("text").collect()] == [(1, None, "x", "y", 3), (None, "a [SECRET] b", "x", "y", 3)]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"token=abcdefgh{i}" for i in range(3000))
    got = scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_assign"] == 3000
    assert got["base_sha256"] == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in brute(text)).encode()).hexdigest()
