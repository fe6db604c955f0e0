import glob
import hashlib
import os
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from leadspark.llm import fill_middle as fm
from leadspark.llm.queries import QUERIES
from tests.llm.fixtures import awkward_docs, empty_docs

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
SF = "/root/testdata/sf0.001"


def plain_row(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n, sha = len(units), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(a), len(b), sha(f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}"), sha(text)


def ordered(rows):
    return sorted(rows, key=str)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ@[`{ é中🙂\n\0<PS>", max_size=50), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_ends_and_parts_of_any_text(text, h):
    units, raw = UNIT.findall(text), text.encode()
    n, form, prefix, middle, n_prefix, n_middle = fm.choose(raw, h)
    assert n == len(units)
    if form == "plain":
        return
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    assert (raw[:prefix].decode(), raw[prefix:middle].decode()) == ("".join(units[:low]), "".join(units[low:high]))
    assert (n_prefix, n_middle) == (len("".join(units[:low])), len("".join(units[low:high])))
    assert fm.restore(fm.transform(raw, form, prefix, middle), form) == raw


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=40))
def test_every_rank_is_selected(text):
    raw, units = text.encode(), UNIT.findall(text)
    n, ends = fm.select_ends(fm.end_marks(fm.as_words(raw), len(raw)), range(len(units) + 1))
    assert n == len(units) and ends == [len("".join(units[:k]).encode()) for k in range(n + 1)]


def test_documents(spark):
    docs = awkward_docs(spark).unionByName(spark.createDataFrame([(None, "no id here"), (None, None), (900, "has <S> in it"), (901, "word, " * 250_000)], "doc_id long, text string"), allowMissingColumns=True)
    want = [plain_row(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ordered(map(tuple, fm.fill_middle_digests(docs).collect())) == ordered(want)
    out = fm.fill_middle(docs).collect()
    assert sorted(hashlib.sha256(r["output"].encode()).hexdigest() for r in out) == sorted(w[5] for w in want)


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/documents.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rel = duck.sql(fm.SQL)
    got = QUERIES["op12_fill_middle"](spark, SF)
    assert got.columns == rel.columns
    assert ordered(map(tuple, got.collect())) == ordered(rel.fetchall())


def test_empty_table(spark):
    assert fm.fill_middle(empty_docs(spark)).collect() == fm.fill_middle_digests(empty_docs(spark)).collect() == []
