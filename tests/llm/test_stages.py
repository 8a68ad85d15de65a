"""Stages of the pipeline against plain versions, each on the rows its predecessor kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codesieve.llm import decontaminate, html_extract, near_dedup, shared, toxicity

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs = shared.table(spark, D, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = shared.staged(stage(spark, docs, D), name)
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def _shingles(text, size=5):
    w = shared.words(text or "")
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _one_of_each(rows, size=5, percent=80):
    """Places of the rows that stay: of each group of linked texts the smallest doc_id's, once; rows without words all."""
    sets = [_shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            best.setdefault(find(i), []).append((doc, i))
    return [i for i, s in enumerate(sets) if not s] + [min(x)[1] for x in best.values()]


def test_near_duplicate_stage_equals_all_pairs(stages):
    before, after = stages["near_duplicates"]
    want = _one_of_each([(r.doc_id, r.text) for r in before])
    assert sorted(before[i].doc_id for i in want) == sorted(r.doc_id for r in after) and len(after) < len(before)
    assert {r.doc_id: r for r in before if r.doc_id in {x.doc_id for x in after}} == {r.doc_id: r for r in after}


def test_decontamination_stage_equals_whole_searches(stages, spark):
    before, after = stages["decontamination"]
    items = [decontaminate.keys(r.text or "").tolist() for r in shared.table(spark, D, "benchmark").collect()]
    kept = []
    for r in before:
        words = decontaminate.keys(r.text or "").tolist()
        if not any(x and decontaminate.myers(x, words, decontaminate.budget(len(x))) for x in items):
            kept.append(r.doc_id)
    assert sorted(kept) == sorted(r.doc_id for r in after) and len(after) < len(before)


def test_toxicity_and_secret_stages_keep_the_rest(stages, spark):
    before, after = stages["toxicity"]
    lexicon = toxicity.learn(shared.table(spark, D, "documents"), shared.table(spark, D, "labels"))
    assert sorted(r.doc_id for r in before if lexicon.score(r.text or "")[0] < toxicity.THRESHOLD) == sorted(r.doc_id for r in after)
    before, after = stages["secrets"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert {c for c in before[0].asDict()} == {c for c in after[0].asDict()}


KIND = "doc_id long, text string, t string, row int"


def test_repeated_ids_keep_their_own_texts(spark):
    a, b, c = "one two three four five six seven eight nine ten", "quite another text that nothing else here is like at all", "x y z"
    rows = [(3, a, "p", 1), (5, a, "q", 2), (5, b, "r", 3), (5, b, "s", 4), (7, None, "u", 5), (7, "", "v", 6), (None, a, "w", 7), (None, a, "w", 8), (9, c, "y", 9), (9, c, "y", 9), (2, b + " more", "z", 10)]
    df = spark.createDataFrame(rows, KIND)
    out = near_dedup.one_of_each(df.repartition(3))
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and r.text)
    assert got == [(2, b + " more"), (3, a), (9, c)] and out.filter("doc_id is null").count() == 2 and out.filter("doc_id = 7").count() == 1
    far = near_dedup.one_of_each(spark.createDataFrame([(3, a, "", 0), (5, a, "", 0), (5, b, "", 0)], KIND))
    assert sorted((r.doc_id, r.text) for r in far.collect()) == [(3, a), (5, b)]
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert (5, 6, 3, False) in near and (5, 7, 2, False) in near and (None, 6, None, True) in near and (7, 0, 7, True) in near
    assert near_dedup.one_of_each(df.limit(0)).count() == 0


def test_items_of_equal_words_are_each_found(spark):
    bench = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha, BETA gamma!"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say alpha beta gamma now", "", 1), (1, "nothing", "", 2), (None, "alpha beta gamma", "", 3)], KIND)
    for chars in (1000, 10):
        assert sorted(map(tuple, decontaminate.contaminated(docs, bench, chars).select(F.coalesce("doc_id", F.lit(-1)), "item_id", "distance").collect())) == [(-1, 1, 0), (-1, 2, 0), (1, 1, 0), (1, 2, 0)]
        assert [r.row for r in decontaminate.clean(docs, bench, chars).collect()] == [2]


@pytest.mark.parametrize("page, want", [
    ('<article><p>P is here.</p><article class="comment"><p>Q</p></article></article>', "P is here."),
    ('<main><p>Text of the page, with words.</p><div class="newsletter"><p>Sign up for our letter.</p></div><p>More of it here.</p></main>', "Text of the page, with words. More of it here."),
    ("<article><h1>T</h1><p>Some text, which is long enough.</p><p><a>Read the original paper</a></p><p>End of it.</p></article>", "T Some text, which is long enough. Read the original paper End of it."),
    ("<article><p>Some text.</p><h2>Sources</h2><ul><li><a>One source here</a></li><li><a>Other source</a></li></ul></article>", "Some text. Sources One source here Other source"),
    ("<article><p>Intro text.</p><p>See <a>this long link text for more</a> and <a>that other link</a>.</p></article>", "Intro text. See this long link text for more and that other link."),
    ("<article><p>A real text.</p><form><label>Mail</label><input></form></article>", "A real text."),
    ("<div>This is one full paragraph of text that stands alone, with some words in it.</div>", "This is one full paragraph of text that stands alone, with some words in it."),
    ("<div><p>short one</p><p>short two</p></div>", "short one short two"),
    ("just text", "just text"),
])
def test_html_of_links_comments_and_single_blocks(page, want):
    assert html_extract.trained().text(page) == want
