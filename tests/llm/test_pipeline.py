"""The pipeline over planted documents, stage by stage and whole."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from quarry.llm import near_copies, simhash
from quarry.llm.queries import vocabulary

COMMON = {"en": "the and of that with was for this from they have been their would about", "de": "der und das nicht ein mit sich auf dem werden haben durch gegen einer"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    text = lambda lang, n: " ".join(rng.choice(COMMON[lang].split(), n).tolist())
    rows = [(i, text(lang := sorted(COMMON)[i % 2], int(rng.integers(30, 90))), lang) for i in range(120)]
    passage = text("en", 60)
    rows += [(200, rows[0][1], "de"), (201, rows[0][1], "de")]  # copies
    rows += [(202, "12345 !!! 678", "en"), (203, None, "en"), (204, "", None)]  # no language
    rows += [(k, f"{text('en', 25)} {passage} {text('en', 25)}", "en") for k in (205, 206)]  # a passage of two
    rows += [(207, f"{text('en', 30)} token = \"d2480315a6562b81c25342984c4087344558d00e\" {text('en', 9)}", "en")]  # a secret
    path = tmp_path_factory.mktemp("sf")
    table = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), {i: t for i, t, _ in rows}, passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    assert set(kept["language"]) == set(texts) - {202, 203, 204}
    components = {r.component for r in simhash.near_duplicates(spark.createDataFrame(list(kept["language"].items()), "doc_id bigint, text string")).collect()}
    assert set(kept["near_duplicates"]) == components and not {200, 201} & components
    for k in (205, 206):
        assert passage in kept["near_duplicates"][k] and passage not in kept["repeated_passages"][k]
    untouched = [i for i in kept["secrets"] if i not in (205, 206, 207)]
    assert all(kept["secrets"][i] == texts[i] for i in untouched)
    assert "d2480315" not in kept["secrets"][207] and "[secret]" in kept["secrets"][207]


def test_run(spark, folder):
    path, texts, _ = folder
    rows = entry.queries()["pipeline"](spark, path).collect()
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    sizes = {r.doc_id: r.doc_tokens for r in rows}
    assert not {200, 201, 202, 203, 204} & set(sizes)
    assert sizes[3] == len(tokenizer.encode(texts[3], add_special_tokens=False).ids) + 1
    assert max(r.offset + r.length for r in rows) <= 2048
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "secrets", "packing"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_few_changes(spark, folder):
    """Copies with some words changed have a five-word similarity over 0.8 and go, though most differ in more than 2 bits."""
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in rng.integers(0, 3000, 200)] for _ in range(10)]
    rows = [(i, " ".join(x)) for i, x in enumerate(words)]
    for i in range(10):
        for k in range(3):
            copy = list(words[i])
            for at in rng.choice(200, 3, replace=False).tolist():
                copy[at] = f"n{rng.integers(10**6)}"
            rows.append((100 + 3 * i + k, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, folder[0]).collect()) == list(range(10))


def versions(rng, n, words, changes):
    """Texts that differ from one by some changed words each, and the least of those that pairs of 0.8 or more link, by all pairs."""
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, words)], []
    for _ in range(n):
        x = list(base)
        for at in rng.choice(words, changes, replace=False).tolist():
            x[at] = f"n{rng.integers(10**9)}"
        texts.append(" ".join(x))
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in map(str.split, texts)]
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if up[i] != up[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return texts, sorted(set(up))


def test_links_that_no_hub_has(spark, folder, monkeypatch):
    """Many versions just below the similarity, of which few pairs reach it: none stays whose bucket has a similar member."""
    monkeypatch.setattr(near_copies, "LEAST", 16384)  # several tiles
    texts, kept = versions(np.random.default_rng(5), 240, 150, 3)
    assert 100 < len(kept) < 230
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = dict(pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, folder[0]).collect()) == kept
    assert len(near_copies.deduplicated(docs, exact=False).collect()) > len(kept)


def test_texts_that_meet_nothing_stay(spark):
    """Of a table of which few texts share a bucket, only those are sent, also where their ids are too many to be broadcast."""
    rng = np.random.default_rng(8)
    rows = [(i, 1000 + i, " ".join(f"{x:x}" for x in rng.integers(1 << 60, size=500).tolist())) for i in range(300)]
    rows += [(300, 1300, rows[7][2] + " end"), (7, 1400, rows[7][2])]  # a near copy, a copy
    size = sum(len(t) for *_, t in rows)
    table = spark.createDataFrame(rows, "node bigint, id bigint, text string")
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s := found.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(found.size())}

    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), max(stages(), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [tuple(r) for r in near_copies.classes(table).collect()] == [(300, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    sent = sum(n for k, n in stages().items() if k > before)
    assert 0 < sent < size / 4
