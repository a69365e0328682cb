import random

from quaestor.llm import leakage
from quaestor.llm.leakage import leaks, terms_of

WORDS = [f"w{k}" for k in range(60)]


def brute(docs, items, n):
    at = {}
    for i, t in items:
        w = terms_of(t or "")
        for s in range(len(w) - n + 1):
            at.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = terms_of(t or "")
        for s in range(len(w) - n + 1):
            out |= {(d, i) for i in at.get(tuple(w[s : s + n]), ())}
    return out


def run(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as longest", "'y' as kind")
    b = spark.createDataFrame(items, "item_id long, text string")
    return leaks(a, b, **kw)


def corpus(seed=1):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(4, 40)))) for i in range(30)] + [(99, None), (100, ""), (101, "too short")]
    docs = []
    for d in range(120):
        w = [r.choice(WORDS) for _ in range(r.randrange(5, 120))]
        if d % 3 == 0:
            src = terms_of(items[r.randrange(30)][1])
            a = r.randrange(max(1, len(src) - 8))
            w[3:3] = src[a : a + r.randrange(8, 20)]
        docs.append((d, " ".join(w).upper() if d % 2 else ",\n".join(w)))
    return docs + [(200, None), (201, ""), (None, items[0][1]), (5, docs[5][1])], items


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(leakage, "SHARD_TOKENS", 500)
    got = {(r.doc, r.item_id) for r in run(spark, docs, items).collect()}
    assert got == {x for x in brute(docs, items, 10) if x[0] is not None} and len(got) > 10


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus(2)
    whole = {tuple(r) for r in run(spark, docs, items).collect()}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in run(spark, docs, items).collect()} == whole


def test_extent_and_proximity(spark):
    item = " ".join(f"t{k}" for k in range(20))
    w = item.split()
    broken = w[:5] + ["xx"] + w[5:12]
    docs = [(1, item), (2, " ".join(w[2:13])), (3, " ".join(broken)), (4, "nothing here")]
    exact = {r.doc: r for r in run(spark, docs, [(1, item)]).collect()}
    assert exact[1].longest == 20 and exact[1].coverage == 1.0 and exact[2].longest == 11 and set(exact) == {1, 2}
    near = {r.doc: r.kind for r in run(spark, docs, [(1, item)], slack=2, most=8).collect()}
    assert near == {1: "exact", 2: "exact", 3: "near"}


def test_passage_does_not_run_over_two_documents(spark):
    item = " ".join(f"t{k}" for k in range(12))
    w = item.split()
    assert run(spark, [(1, " ".join(w[:6])), (2, " ".join(w[6:]))], [(1, item)]).count() == 0


def test_empty_tables(spark):
    assert run(spark, [(1, "a")], [(1, "b")]).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert leaks(docs, spark.createDataFrame([(1, "a " * 12)], "item_id long, text string")).count() == 0
    assert leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_near(docs, items, n=10, slack=2, most=8):
    """Every place in every document, counting the words near theirs."""
    out = set()
    for d, t in docs:
        w = terms_of(t or "")
        for i, text in items:
            own = terms_of(text or "")
            for s in range(len(own) - n + 1):
                for at in range(-n, len(w) + n):
                    if sum(own[s + j] in w[max(0, at + j - slack) : max(0, at + j + slack + 1)] for j in range(n)) >= most:
                        out.add((d, i))
    return out


def changed(seed, count):
    """Lone passages with two words changed, in documents with words of their own around them."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(10, 14)))) for i in range(count)]
    docs = []
    for d in range(3 * count):
        w = terms_of(items[d % count][1])[:10]
        for j in r.sample(range(10), 2 + (d % 7 == 0)):
            w[j] = r.choice(["other", "w1", f"new{d}"])
        if d % 4 == 1:
            w.insert(r.randrange(10), "extra")
        docs.append((d, " ".join([f"o{r.randrange(50)}" for _ in range(20)] + w + [r.choice(words) for _ in range(20)])))
    return docs, items


def test_changed_rare_words_equal_brute_force(spark):
    docs, items = changed(3, 25)
    got = {(r.doc, r.item_id) for r in run(spark, docs, items, slack=2, most=8).collect()}
    assert got == brute_near(docs, items) and len(got) > 50


def test_passage_without_its_first_words_belongs_to_its_document(spark):
    item = " ".join(f"t{k}" for k in range(10))
    w = item.split()
    docs = [(d, " ".join(w[1 + d % 3 % 2 :]) if d % 3 else "innocent words") for d in range(90)]  # several in each shard
    got = run(spark, docs, [(1, item)], slack=2, most=8).collect()
    assert {r.doc for r in got} == {d for d in range(90) if d % 3}


def test_long_runs_do_not_reach_over_the_gap(spark):
    w = [f"t{k}" for k in range(90)]
    docs = [(d, " ".join(w[76:] if d % 2 else w[:12])) for d in range(90)]
    assert run(spark, docs, [(1, " ".join(w))], words=90, slack=2, most=20).count() == 0


def test_text_ids_and_one_index_for_several_item_sets(spark, monkeypatch):
    docs, items = corpus(3)
    a = spark.createDataFrame([(None if d is None else f"d{d:03}", t) for d, t in docs], "doc_id string, text string")
    stage = leakage.build_index(a, "doc_id", "text")
    want = {(f"d{d:03}", f"i{i:03}") for d, i in brute([x for x in docs if x[0] is not None], items, 10)}
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    got = set()
    for half in (items[:15], items[15:]):
        b = spark.createDataFrame([(f"i{i:03}", t) for i, t in half], "item_id string, text string")
        got |= {(r.doc, r.item_id) for r in leakage.search_index(stage.df, b).collect()}
        near = {(r.doc, r.item_id) for r in leakage.search_index(stage.df, b, slack=2, most=8).collect()}
        assert near >= {x for x in want if x[1] in {f"i{i:03}" for i, _ in half}}
    assert got == want and want
