"""Chat formatting (6), page extraction (7), near copies (10) and the pipeline."""

import collections
import hashlib
import html
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from sparktab.llm import chat_events, html_cut, minhash_forest, queries
from sparktab.llm.components import components

SIGNS = ["<", "s>", ">", "/", "[", "INST]", "\\", "|", *chat_events.CONTROL, "SYS>>", "<<", " ", "im_end|>", "a", "é", "\n"]


@given(st.lists(st.sampled_from(SIGNS), max_size=14).map("".join), st.sampled_from(["user", "assistant", "system", "", "tool", "we[/ROLE]ird 7 "]))
@settings(max_examples=500, deadline=None)
def test_segments_round_trip(text, role):
    body = chat_events.protect(text)
    assert not any(c in body for c in chat_events.CONTROL) and chat_events.restore(body) == text
    segment, low, high = chat_events.render(role, text)
    assert chat_events.parse(segment) == (role, text)
    assert (low is not None) == (role == "assistant") and (low is None or chat_events.restore(segment[low:high]) == text)


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "Good"),
        (1, 1, 5, "delta", None, " day"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "edit", None, "y"), (1, 3, 8, "message", "user", "gone"), (1, 3, 9, "delete", None, None),
        (2, 0, 0, "delta", "assistant", "alone"), (2, 0, 1, "message", "tool", None), (2, 0, 1, "message", "tool", None), (None, None, None, "message", None, "n"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").withColumnRenamed("seq", "seq").repartition(4)
    rows = chat_events.formatted(events).collect()
    got = {(r.conv_id, r.turn, r.number): chat_events.parse(r.segment) for r in rows}
    assert got == {(1, 0, 0): ("user", "hi"), (1, 1, 0): ("assistant", "Good day"), (1, 2, 0): ("user", "y"), (2, 0, 0): ("assistant", "alone"), (2, 0, 1): ("tool", ""), (2, 0, 2): ("tool", ""),
                   (None, None, 0): ("", "n")}
    assert chat_events.formatted(events.limit(0)).count() == 0
    back = {r.conv_id: r for r in chat_events.read_back(chat_events.formatted(events)).collect()}
    assert back[1].n_turns == 3 and back[1].loss_chars == 8 and back[None].loss_chars == 0


def test_chat_query(spark, sf):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.QUERIES["op6_chat_formatting"](spark, sf).collect()}
    assert got.keys() == turns.keys()
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def cut_value(source, sink, edges, side):
    return sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])


def test_minimum_cut_is_minimal():
    random.seed(1)
    for _ in range(200):
        n = random.randint(1, 7)
        source, sink = [random.random() * 3 for _ in range(n)], [random.random() * 3 for _ in range(n)]
        edges = [(i, j, random.random()) for i in range(n) for j in range(i) if random.random() < 0.5]
        best = min(cut_value(source, sink, edges, [m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cut_value(source, sink, edges, html_cut.minimum_cut(source, sink, edges)) == pytest.approx(best)


PAGE = """<html><head><title>T</title></head><body class="home page"><header><h1>Site</h1><p>Tagline of our site is long enough to be a sentence here.</p></header>
<div class="cookie-notice"><p>We use cookies to improve your experience on this web site, and by using it you agree.</p></div><div id=main-content><h1>Title</h1>
<p>A first   paragraph with quite some words in it, so that it counts.</p><div class=ad><p>Buy this thing now, it is the best thing that was ever made!</p></div><p>Short.</p>
<form><label>Name</label><input></form><p>Second paragraph follows here &amp; ends; a &lt; b.</p><aside><p>Related reading that is long enough to look like a sentence, too.</p></aside></div>
<section id="comments"><h3>Comments</h3><p>I think that this article is great and I would like to say so at length.</p></section><footer><p>Copyright somebody and so on.</p></footer></body></html>"""


def test_furniture_goes_and_the_article_stays():
    assert html_cut.main_text(PAGE) == (
        "Title\n\nA first paragraph with quite some words in it, so that it counts.\n\nShort.\n\nSecond paragraph follows here & ends; a < b.")


@pytest.mark.parametrize("page", [None, "", "<", "a<b", "<p", "<!-- x", "<script>a", '<a href="x>y">t</a>', "</p></p></div>", "<p class='x", "<tr><td>a<tr>", "\x00", "<a " + '"' * 5000])
def test_broken_markup_never_fails(page):
    assert isinstance(html_cut.main_text(page), str)


def test_long_pages():
    page = "<article>" + "".join(f"<p>Paragraph {i} has a few words.</p><div class=ad>Buy {i}</div>" for i in range(4000)) + "</article>"
    assert html_cut.main_text(page) == "\n\n".join(f"Paragraph {i} has a few words." for i in range(4000))


def test_page_query(spark, sf):
    for r in queries.QUERIES["op7_html_extraction"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>")[1].split("</article>")[0].split("<footer")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " ")))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def brute_groups(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        key = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None
        sets.setdefault(key, []).append(doc)
    keys = [k for k in sets if k]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a in range(len(keys)):
        for b in range(a):
            common = len(keys[a] & keys[b])
            if common >= 0.8 * (len(keys[a]) + len(keys[b]) - common):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, k in enumerate(keys):
        least[find(a)] = min(least.get(find(a), 1 << 60), min(sets[k]))
    out = {doc: (doc, doc, 1, 0) for doc in sets.get(None, ())}
    for a, k in enumerate(keys):
        out |= {doc: (least[find(a)], min(sets[k]), len(sets[k]), links[a]) for doc in sets[k]}
    return out


def near_rows():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in [[random.choice(words) for _ in range(random.randint(3, 120))] for _ in range(40)]:
        for _ in range(random.randint(1, 30)):
            own = base[:]
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = random.choice(words)
            rows.append((len(rows), " ".join(own)))
    for text in (None, "", "  \n", "a b", "a b", "a  b", "long " * 30_000):
        rows.append((len(rows), text))
    return rows


@pytest.mark.parametrize("block", [7, 800])  # groups of many blocks, and of one
def test_near_copies_match_brute_force(spark, block):
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_copies, r.n_links) for r in minhash_forest.near_copies(frame, block=block).collect()}
    assert got == brute_groups(rows)


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    expected = {i for i, x in brute_groups(rows).items() if x[0] == i}
    frame = spark.createDataFrame([(i, t, i) for i, t in rows] + [(None, "x y", -1), (None, "x y", -2)], "doc_id long, text string, k int")
    kept = minhash_forest.keep_one(frame)
    found = sorted(r.k for r in kept.collect())
    assert kept.columns == frame.columns and found in (sorted(expected | {-1}), sorted(expected | {-2}))  # one of two rows without an id
    assert minhash_forest.keep_one(frame.limit(0)).count() == 0


def test_repeated_rows_leave_one_that_keeps_its_words(spark):
    import corpus_pipeline

    texts = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abc"}
    near = texts["a"].replace("a59", "z")
    rows = [(1, texts["a"], 60), (1, texts["a"], 60), (5, near, 60), (5, texts["b"], 60), (6, texts["c"], 60), (7, None, 0), (7, None, 0)]
    rows += [(None, texts["b"], 60), (None, "only " + texts["c"].replace("c", "n"), 61), (None, "only " + texts["c"].replace("c", "n"), 61), (None, near, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.jaccard_join(spark, frame, "")
    expected = sorted([(1, texts["a"]), (5, texts["b"]), (6, texts["c"]), (7, None), (7, None), (None, "only " + texts["c"].replace("c", "n"))], key=str)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == expected
    assert sorted([(r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, kept, "").collect()], key=str) == expected


def test_classes_are_verified_with_their_own_text(spark):
    random.seed(11)
    texts = []
    for g in range(6):
        own = [f"g{g}w{i}" for i in range(60)]
        texts += [" ".join(own), " ".join([*own[:-1], "other"])]
    for ids in ([None] * 12, [7] * 12):  # all texts share an id
        out = minhash_forest.near_copies(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
        assert [(r.n_copies, r.n_links) for r in out] == [(1, 1)] * 12


def test_dense_blocks_and_sparse_ones_agree():
    import numpy as np
    import pyarrow as pa

    from sparktab.llm.words import flat, words_of

    random.seed(5)
    base = [f"v{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        own = base[:]
        for _ in range(random.randint(0, 6)):
            own[random.randrange(80)] = f"u{random.randint(0, 30)}"
        texts.append(" ".join(own))
    value, first = minhash_forest.shingle_sets(words_of(*flat(pa.array(texts))))
    prefix = np.zeros((150, 1), np.uint64)  # every pair is a candidate
    every = np.arange(150)
    many = set(zip(*(x.tolist() for x in minhash_forest.similar_pairs(value, first, prefix, every, every, 0.8))))
    few = set()
    for i in range(150):
        few |= set(zip(*(x.tolist() for x in minhash_forest.similar_pairs(value, first, prefix, every[i:i + 1], every[i + 1:], 0.8))))
    assert many == few and 0 < len(many) < 150 * 149 // 2


def test_recall_of_the_forest():
    d = minhash_forest.matched_depth()
    assert 1 - (1 - 0.8 ** d) ** minhash_forest.TREES >= minhash_forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** minhash_forest.TREES


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 999), (1000, 998), (5000, 5000)]
    random.seed(2)
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {i: 0 for i in range(301)} | {998: 998, 999: 998, 1000: 998}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else stage(spark, docs, sf).cache()
        steps[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe_encoding":
            assert docs.columns == names and all(r.n_chars == len(r.text or "") for r in steps[name].values())
    verdict = {r.doc_id: r.kept for r in queries.QUERIES["op2_quality_rules"](spark, sf).collect()}
    assert steps["quality_rules"].keys() == {i for i in before if verdict[i]}
    groups = brute_groups([(i, r.text) for i, r in steps["quality_rules"].items()])
    assert steps["jaccard_join"].keys() == {i for i, g in groups.items() if g[0] == i}
    assert steps["substring_dedup"].keys() == steps["jaccard_join"].keys()
    assert steps["benchmark_decontamination"].keys() <= steps["substring_dedup"].keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in steps["bpe_encoding"].items():
        ids = library.encode(steps["benchmark_decontamination"][i].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == b"".join(x.to_bytes(4, "little") for x in ids)
