"""The pipeline against brute-force versions of its stages, at the smallest scale."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from encore.llm.bpe import TOKENIZER
from tests.llm.test_contamination import words_of as item_words
from tests.llm.test_near import set_of

FOLDER = "/root/testdata/sf0.001"


def squeezed(text):
    return "".join(c for c in text if c not in " \t\n\x0b\f\r")


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [item_words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {"start": {r.doc_id: r.text or "" for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}

    best = {}
    for i, t in kept["toxicity"].items():
        best[squeezed(t)] = min(best.get(squeezed(t), (0, 0)) if squeezed(t) in best else ((-len(t), i)), (-len(t), i))
    assert set(kept["exact_dedup"]) == {i for _, i in best.values()}

    sets = {i: set_of(t, 5) for i, t in kept["exact_dedup"].items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(kept["near_dedup"]) == {i for i in ids if find(i) == i}

    def holds(words, item):
        return any(words[k : k + len(item)] == item for k in range(len(words) - len(item) + 1))

    whole = {i for i, t in kept["near_dedup"].items() if any(holds(item_words(t), item) for item in items if item)}
    assert not whole & set(kept["decontamination"])
    assert len(kept["near_dedup"]) - len(kept["decontamination"]) <= len(whole) + 2

    library = Tokenizer.from_file(TOKENIZER)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(kept["decontamination"])
    for r in rows:
        text = kept["decontamination"][r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count() <= spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_stages_take_nulls_repeats_and_empty_tables(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(1, None, None, None, None), (None, None, None, None, None), (None, "some text", "", "", 1), (2, "", "", "", 0), (3, "same  text", "", "", 1), (3, "same  text", "", "", 1), (4, "same text", "", "", 1)]
    for some in (data, []):
        docs = rows(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        got = sorted((str(r.doc_id) for r in docs.collect()))
        assert got == (["1", "3", "None"] if some else [])


def test_rows_of_one_id_are_decided_each(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = max((r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=lambda t: len(t or ""))
    text = lambda word: " ".join(f"{word}{n}" for n in range(60))
    near = lambda word: text(word) + " end"
    data = [
        (1, text("a")), (1, near("a")), (1, text("b")), (None, text("c")), (None, near("c")), (None, text("d")),
        (0, text("e")), (5, near("e")), (5, text("f")), (None, text("g")), (7, near("g")), (None, item), (5, item + " or so"),
    ]
    docs = rows([(i, t, "", "", len(t)) for i, t in data], schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()]
    first = lambda word: [(i, t) for i, t in kept if t in (text(word), near(word))]
    assert [len(first(w)) for w in "abcdefg"] == [1] * 7
    assert first("e") == [(0, text("e"))] and first("g") == [(7, near("g"))]
    clean = corpus_pipeline.decontaminate(spark, docs, FOLDER)
    assert clean.columns == docs.columns
    assert sorted(clean.collect(), key=str) == sorted(docs.where(~docs.text.startswith(item)).collect(), key=str)
