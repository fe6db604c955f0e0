import random
import re
import zlib

import corpus_pipeline
import pytest
from leadspark.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from tests.llm.test_decontaminate import smith_waterman
from tests.llm.test_near_dedup import brute as near_groups
from tests.llm.test_secret_scan import brute as base_spans


def test_every_stage_works_on_what_is_left(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns = docs.columns
    want = {r["doc_id"] for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, labels)
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert docs.columns == columns
        if name == "toxicity":
            want -= bad
        elif name == "near_duplicates":
            want = {r["doc_id"] for r in near_dedup.near_duplicate_groups(before).where("kept").collect()}
        elif name == "benchmark_leaks":
            want -= {r["doc_id"] for r in decontaminate.find_leaks(before, benchmark).collect()}
        elif name == "secrets":
            found = secret_scan.scan_secrets(before).where("spans <> ''").count()
            masked = docs.where("text like '%[SECRET]%'").count()
            assert found == masked
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    tokens = packing.token_pieces(before, packing.tokenizer_path()).agg({"length": "sum"}).first()[0]
    assert docs.agg({"length": "sum"}).first()[0] == tokens
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_null_ids_and_texts_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    prose = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    item = prose("leak")
    clean = [(None, prose("a")), (None, prose("b")), (1, prose("c")), (1, prose("d")), (2, prose("e")), (5, prose("h"))]
    copies = [(2, prose("e")), (3, f"{prose('e')} more"), (None, prose("e")), (None, prose("a"))]
    leaks = [(None, f"{prose('f')} {item}"), (5, f"{prose('g')} {item}")]
    docs = spark.createDataFrame([*clean, *copies, *leaks], "doc_id long, text string").repartition(3)
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    key = lambda rows: sorted(((r[0] is None, r[0] or 0, r[1]) for r in rows))
    assert key(kept.collect()) == key([*clean, *leaks])
    left = corpus_pipeline.drop_leaks(spark, kept, str(tmp_path))
    assert left.columns == docs.columns and key(left.collect()) == key(clean)
    pieces = corpus_pipeline.pack(spark, left, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in pieces) == sorted(str(i) for i, _ in clean)


def test_whole_run_equals_plain_python(spark, tmp_path):
    """Every stage worked out without Spark on a small corpus with planted cases."""
    rnd = random.Random(11)
    pieces = "ation ing ent er the con pro ment al is ten ver min ter ly ous re de un in com per".split()
    word = lambda: "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    insults = ["vermin7x", "wretchy", "numskull", "dullard"]
    insults[0] = "verminous"
    items = {i: prose(30) for i in range(4)}
    rows, labels = [], []
    for i in range(160):
        text, toxic = prose(rnd.randrange(20, 60)), i % 5 == 0
        if toxic:
            text += rnd.sample(insults, 3)
        elif i % 5 == 1:
            text += items[i % 4] if i % 2 else [w if rnd.random() > 0.1 else "edit" for w in items[i % 4]]
        elif i % 5 == 2 and i > 20:
            text = rows[i - 5][1].split(" ")
            text[rnd.randrange(len(text))] = "changed"
        elif i % 5 == 3:
            text.insert(3, "token=" + "".join(rnd.choice("abcdef012345") for _ in range(12)))
        rows.append((i, " ".join(text), "en", "s", len(" ".join(text))))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: text for i, text, *_ in rows if not set(text.split()) & set(insults)}
    groups = near_groups(left.items())
    left = {i: text for i, text in left.items() if groups[i][2]}
    numbers: dict[str, int] = {}
    code = lambda words: [numbers.setdefault(w, len(numbers)) for w in words]
    leaked = {i for i, text in left.items() if any(smith_waterman(code(item), code(text.split())) >= 0.8 * len(item) for item in items.values())}
    left = {i: text for i, text in left.items() if i not in leaked}
    for i, text in left.items():
        for a, _, b in reversed(base_spans(text)):
            text = text[:a] + "[SECRET]" + text[b:]
        left[i] = text
    tokenizer = __import__("tokenizers").Tokenizer.from_file(packing.tokenizer_path())
    want = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 0] for i, text in left.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for i, ids in want.items()}
    assert len({r["sequence_id"] for r in got}) == -(-sum(map(len, want.values())) // 2048)
    assert len(want) < 130 and any(re.search(r"\[SECRET\]", t) for t in left.values()) and leaked


@pytest.mark.parametrize("name", ["op1_pack", "op2_secrets", "op3_repeats", "op4_quality", "op5_toxicity", "op8_near_duplicates", "op9_shards", "op10_fingerprints"])
def test_rows_without_id_and_clashing_columns(spark, tmp_path, name):
    """Rows without an id and repeated rows give a row each; other columns do no harm."""
    from leadspark.llm.queries import QUERIES

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (None, None), (1, text), (1, text), (1, "other text"), (2, ""), (None, text)]
    clash = ("n", "row", "th", "bucket", "hub", "cid", "label", "score", "spans", "_part", "hash", "size", "_t", "words", "token")
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'z' AS `{c}`" for c in clash])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    assert ids == sorted((i is None, i or 0) for i, _ in rows)
