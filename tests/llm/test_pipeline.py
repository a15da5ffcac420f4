import inspect

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from emberline.llm import bpe, line_dedup
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import brute_groups, brute_print

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_equal_a_brute_force_version(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(llm, docs, SF)
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert first.columns == docs.columns and kept <= {i for i, n in words.items() if n >= 20}
    good = [i for i, q in labels.items() if q and words[i] >= 20]
    assert sum(i in kept for i in good) >= 0.97 * len(good)

    second = corpus_pipeline.lines(llm, first, SF)
    sites, place = {}, {}
    for r in first.collect():
        for k, line in enumerate(r["text"].split("\n")):
            sites.setdefault(line, set()).add(r["source"])
            place[line] = min(place.get(line, (1 << 60, 0)), (r["doc_id"], k))
    want = {}
    for r in first.collect():
        lines = [x for k, x in enumerate(r["text"].split("\n")) if not (x.split() and len(sites[x]) >= line_dedup.MIN_SITES and place[x] != (r["doc_id"], k))]
        want[r["doc_id"]] = "\n".join(lines)
    assert second.columns == docs.columns and {r["doc_id"]: r["text"] for r in second.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = corpus_pipeline.near_duplicates(llm, second, SF)
    groups = brute_groups({i: brute_print(t) for i, t in want.items()})
    assert {r["doc_id"] for r in third.collect()} == {i for i, g in groups.items() if i == g}

    fourth = corpus_pipeline.mixing(llm, third, SF)
    left = [(r["doc_id"], r["text"], r["source"]) for r in third.collect()]
    size, _, _, taken = brute_mix(left)
    counts = {}
    for r in fourth.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert fourth.columns == docs.columns and counts == {i: taken[i] // size[i] for i in size if taken[i]}

    last = corpus_pipeline.encoding(llm, fourth, SF)
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r["doc_id"], r["n_tokens"]) for r in last.collect()) == sorted((r["doc_id"], len(coder.encode_ordinary(r["text"]))) for r in fourth.collect())
    assert all(r["round_trip"] for r in last.collect())
    assert rows(corpus_pipeline.run(llm, SF)) == rows(last)


def test_stages_on_an_empty_table(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = stage(llm, docs, SF)
        assert docs.collect() == []


def test_every_stage_on_nulls_repeats_long_texts_and_clashing_names(llm):
    """Each stage on the same rows: which rows stay is given as (doc_id, first characters of the text)."""
    good = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"thing{i % 250} goes" for i in range(200))
    shared = "This line stands on all of the sites that there are"
    long = " ".join(f"v{i % 90001}" for i in range(200_000))
    texts = [(1, good), (1, good), (2, good + " end"), (None, other), (None, None), (3, None), (4, ""), (5, long), (6, "few words")]
    rows = [(i, t, "en", f"s{k}", len(t or ""), "clash", k, "x", 1.5) for k, (i, t) in enumerate(texts)]
    rows += [(100 + k, f"{shared}\n" + " ".join(f"own{k}x{j}" for j in range(60)), "en", f"t{k}" if k else None, 0, "clash", k, "x", 1.5) for k in range(12)]
    extra = "kept string, _row int, component string, n_tokens double"
    docs = llm.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    def ids(df):
        return sorted((r["doc_id"] or 0 for r in df.collect()))

    new = list(range(100, 112))
    first = corpus_pipeline.quality(llm, docs, SF)
    assert first.columns == docs.columns and set(ids(first)) <= {0, 1, 2, 5, *new} and not [r for r in first.collect() if not r["text"]]
    second = corpus_pipeline.lines(llm, docs, SF)
    assert second.columns == [c for c in docs.columns if c != "_row"] and ids(second) == ids(docs)
    got = {r["doc_id"]: r for r in second.collect() if r["doc_id"] is not None}
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == long and got[100]["text"].startswith(shared)
    assert all(shared not in got[k]["text"] and got[k]["n_chars"] == len(got[k]["text"]) for k in new[1:]) and got[1]["kept"] == "clash"
    third = corpus_pipeline.near_duplicates(llm, docs, SF)
    assert third.columns == docs.columns
    # 3 and 4 are alike without words; rows without an id stay
    assert {0, 1, 3, 5, 6} <= set(ids(third)) and ids(third).count(1) == 1 and ids(third).count(0) == 2 and 4 not in ids(third)
    fourth = corpus_pipeline.mixing(llm, docs, SF)
    assert fourth.columns == docs.columns and not {3, 4} & set(ids(fourth)) and all(r["text"] for r in fourth.collect())
    last = corpus_pipeline.encoding(llm, docs, SF)
    assert ids(last) == ids(docs) and {r["n_tokens"] for r in last.collect() if r["doc_id"] in (3, 4)} == {0} and all(r["round_trip"] for r in last.collect())
