"""Line rules (2), template leaks (3) and licence rules (5) against brute force and planted cases."""

import collections
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from sparktab.llm import licence_rules, line_rules, queries, template_leaks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_numbers(text):
    text = text or ""
    words = WORD.findall(text)
    count = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = [False] * len(words)
    for i in range(len(words) - 2):
        if count[tuple(words[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, sum(again)


KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n \t\r中", max_size=60)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_base_numbers(texts):
    base, bounds, owner, fails = line_rules.measure(pa.array(texts, pa.string()), line_rules.phrases())
    assert [tuple(int(base[k][i]) for k in KEYS) for i in range(len(texts))] == [base_numbers(t) for t in texts]
    data = "".join(t or "" for t in texts).encode()
    lines = [[data[a:b].decode() for a, b, o in zip(*bounds.tolist(), owner.tolist()) if o == i] for i in range(len(texts))]
    assert lines == [(t or "").split("\n") for t in texts]


GOOD = "A sentence of some words stands here, and it ends as it should."


def test_lines_fail_by_their_rule():
    lines = [GOOD, "Home | About | Contact | Log in | Help", "a### b*** c&&& d%%% e$$$ f###", "READ THIS NOW BECAUSE IT IS SO VERY LOUD!!", "Accept all cookies to go on.", "Menu",
             " ".join(f"w{i}" for i in range(12)), "so " * 20 + ".", GOOD, "", "No."]
    _, _, _, fails = line_rules.measure(pa.array(["\n".join(lines)]), line_rules.phrases())
    assert fails.tolist() == [False, True, True, True, True, True, True, True, True, False, False]


def test_cleaning_keeps_columns_and_rejects(spark):
    random.seed(1)
    sentences = [" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(random.randint(0, 999)) for _ in range(12)) + "." for _ in range(8)]
    good, mixed, lost = "\n".join(sentences), "\n".join([*sentences, "Menu"]), "\n".join([*sentences[:5], *(s.upper() for s in sentences[5:]), *(s.upper()[::-1] + "." for s in sentences[:3])])
    rows = [(0, good, True), (1, mixed, False), (2, lost, None), (3, None, True), (4, "", True), (5, "too short.", True), (6, " ".join(["a b c"] * 40) + ".", True), (7, good, True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    judged = {r[0]: r for r in line_rules.judged(frame).collect()}
    assert {i: r[-1] for i, r in judged.items()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True}
    assert judged[3][1] is None and [judged[i][-2] for i in range(8)] == [False, False, False, True, True, True, True, False]
    got = {r.doc_id: r for r in line_rules.clean(frame).collect()}
    assert got.keys() == {0, 1, 7} and got[1].text == good and got[1].kept is False
    assert line_rules.clean(frame.limit(0)).columns == frame.columns


def test_good_documents_stay_and_bad_ones_go(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_quality_rules"](spark, sf).collect():
        numbers = base_numbers(texts[r.doc_id])
        assert tuple(r[k] for k in KEYS) == numbers
        assert r.base_failed == (numbers[0] < 50 or 100 * numbers[4] > 50 * numbers[0])
        if r.doc_id in labels:
            assert r.kept == (labels[r.doc_id] == 1 and not r.base_failed)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


QUESTION = "If Alice has 5 apples and buys 3 kg of pears, how many fruits does Alice have now?"


@pytest.mark.parametrize("most", [0, 10**6])  # shuffled and broadcast
def test_changed_numbers_and_names_are_caught_if_slots_agree(spark, most):
    bench = items(spark, [(1, QUESTION), (2, "Short item here now"), (3, "no"), (4, None), (5, "Since Bob has 7 apples and buys 9 g of pears, how many fruits does Bob have now?"), (9, QUESTION)])
    docs = spark.createDataFrame([
        (1, "so " + QUESTION + " ok", 0), (2, "x if Bob has 12 apples and buys 7 lbs of pears, how many fruits does Bob have now", 1),
        (3, "x if Bob has 12 apples and buys 7 lbs of pears, how many fruits does Carl have now", 2), (4, None, 3), (5, "", 4), (6, "a short item here now b", 5),
        (None, "Short, item: here... now!", 6), (7, "if bob", 7), (6, "a short item here now b", 8), (8, ("words of no use " * 3000) + QUESTION, 9), (10, "if\n alice   has 5 apples", 10),
    ], "doc_id long, text string, row_key int")
    got = {(r.doc_id, r.item_id): r for r in template_leaks.leaks(docs, bench, broadcast_windows=most).collect()}
    assert got.keys() == {(1, 1), (1, 5), (2, 1), (2, 5), (6, 2), (None, 2), (8, 1), (8, 5), (8, 3)}  # item 3 is one word, found word by word
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 5 and got[2, 1].n_items == 2
    left = template_leaks.remove_leaks(docs, bench, broadcast_windows=most)
    assert left.columns == docs.columns and {r.row_key for r in left.collect()} == {2, 3, 4, 7, 10}
    assert template_leaks.leaks(docs, bench.limit(0)).count() == 0 and template_leaks.leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("item, text, caught", [
    ("What is the capital of France?", "1) What is the capital of France?", True), ("What is the capital of France?", "- What is the capital of France?", True),
    ("What is the capital of France?", "so What is the capital of Spain", True), ("What is the capital of France?", "tell me what is the capital of france", True),
    ("Tom has 3 apples. Ann has 4 pears. How many?", "x Jim has 5 apples. Sue has 9 pears. How many?", True),
    ("Tom has 3 apples. Ann has 4 pears. How many?", "x Jim has 5 apples; Sue has 9 pears; how many", True),
    ("if Tom has 3 apples and Ann has 4 pears", "If Jim has 5 apples and Sue has 9 pears", True),
    ("Paris Rome Berlin Madrid 12 15", "cities: paris rome berlin madrid 12 15", True), ("Paris Rome Berlin Madrid 12 15", "Oslo Bern Vienna Athens 12 15", False),
    ("Tom has 3 apples and Tom has 4 pears today", "Jim has 5 apples and Sue has 9 pears today", False),
    ("the farmer sold nine large baskets of ripe cherries at the old market near the river before noon that day",
     "the farmer sold nine large baskets of ripe cherries at the very old market near the river before noon that day", True),
    ("one small boat left with its crew for the big island and after two days the whole crew came home safe",
     "one small boat left with its crew for the very big island and then two days the whole crew came home safe", True),
])
def test_readings_plain_windows_and_neighbouring_shifts(spark, item, text, caught):
    docs = spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")
    found = [template_leaks.leaks(docs, items(spark, [(7, item)]), gate_pairs=most).collect() for most in (template_leaks.GATE_PAIRS, 0)]
    assert len(found[0]) == caught and found[0] == found[1]


def test_benchmark_passages_of_the_table(spark, sf):
    """Whole items that stand in a text word by word are found, and no text without a run of 8 words of an item is."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_benchmark_decontamination"](spark, sf).collect()}
    fold = lambda t: " " + " ".join(w for w in (re.sub(r"[^\w]|_", "", x) for x in t.lower().split()) if w) + " "
    folded = {d: fold(t) for d, t in texts.items()}
    assert {(d, i) for i, b in bench.items() for d, t in folded.items() if fold(b) in t} <= got
    for d, i in got:
        own = fold(bench[i]).split()
        assert any(" " + " ".join(own[k:k + 8]) + " " in folded[d] for k in range(len(own) - 7))


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    hits = [(i, label) for phrase, label in licence_rules.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    spots = [i for i, _ in hits]
    return len(words), len(hits), min(spots, default=None), max(spots, default=None), ",".join(sorted({label for _, label in hits}))


PARTS = ["CC", "by", "-", " ", "\n", "MIT", "License", "license", "GNU", "general", "public", "apache", "é", "4.0", "nc", "x", ","]


@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_places(text):
    assert scanner().scan(text)[:5] == base_places(text)


def scanner(kept=[]):  # noqa: B006
    if not kept:
        kept.append(licence_rules.Scanner())
    return kept[0]


@pytest.mark.parametrize("text, labels, score", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 0.98), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl", 0.99), ("Released under the MIT License.", "mit", 0.95),
    ("GNU Lesser General Public License, version 2.1", "lgpl", 0.8), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa", 0.99), ("Boost the mood", "", 0.0),
    ("under the terms of the Mozilla Public License, v. 2.0", "mpl", 0.95), ("the apache licenses", "", 0.0),
])
def test_signatures(text, labels, score):
    found = scanner().scan(text)
    assert found[5] == labels and found[6] == pytest.approx(score)


def test_each_alternative_contains_its_keyword():
    def branches(pattern):
        """Texts of all alternatives of a pattern of this module, repeats once."""
        found = re.search(r"\(\?:([^()]*)\)(\??)|\(([^()?][^()]*)\)(\??)", pattern)
        if found:
            inner = (found[1] if found[1] is not None else found[3]).split("|") + ([""] if found[2] or found[4] else [])
            return [t for x in inner for t in branches(pattern[:found.start()] + x + pattern[found.end():])]
        letter = re.search(r"(\\d|\w| )\?", pattern)
        if letter:
            return branches(pattern[:letter.start()] + letter[1] + pattern[letter.end():]) + branches(pattern[:letter.start()] + pattern[letter.end():])
        return [" ".join(pattern.replace(".{1,80}", "x").replace("\\d", "1").split())]

    for _, _, keyword, pattern in licence_rules.rules():
        for text in branches(pattern.replace(".{1,80}?", ".{1,80}")):
            assert re.fullmatch(pattern, text) and f" {keyword} " in f" {text} ", (keyword, text)


def test_old_licence_address():
    seen = scanner().scan("see www.gnu.org/licenses/old-licenses/gpl-2.0.html there")
    assert seen[5] == "gpl" and seen[6] == pytest.approx(0.95)


def test_inner_detections_are_suppressed():
    seen = scanner().scan("x Licensed under the Apache License, Version 2.0 and the MIT License y")[7]
    assert [(d["label"], d["first"], d["last"]) for d in seen] == [("apache", 1, 8), ("mit", 11, 12)]


def test_sweep_keeps_what_the_pairwise_rule_keeps():
    r = random.Random(5)
    for n in (0, 1, 5, 40, 300):
        for width in (4, 30, 200):
            found = {(b, b + r.randint(1, width), r.randint(1, 4), r.choice("ab"), r.choice("xy")) for b in (r.randrange(width) for _ in range(n))}
            kept = []
            for x in sorted(found, key=lambda x: (-x[2], -(x[1] - x[0]), x[0], x[3], x[4])):
                if not any(k[0] <= x[0] and x[1] <= k[1] for k in kept):
                    kept.append(x)
            assert licence_rules.uncontained(found) == sorted(kept, key=lambda x: (x[0], x[3]))


def test_many_detections_take_linear_time():
    begin = time.perf_counter()
    kept = licence_rules.uncontained((i, i + 3, 1 + i % 4, "a", "x") for i in range(1_000_000))
    assert len(kept) == 1_000_000 and time.perf_counter() - begin < 60
    seen = scanner().scan("mit license or " * 100_000)
    assert seen[1] == len(seen[7]) == 100_000


@pytest.mark.parametrize("text,label", [
    ("You may not use this file except in compliance with the License.", "apache"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-original"),
    ("The Software shall be used for Good, not Evil.", "json"), ("These tools are dual-licensed under X and Y", "dual-licence"),
    ("Altered source versions must be plainly marked as such", "zlib"), ("This is distributed in the hope that they dance", None),
    ("GCC Runtime Library Exception, version 3.1", "gpl-gcc-exception"), ("The name of ACME shall not be used in advertising or otherwise to promote the sale", "x11"),
])
def test_written_clauses(text, label):
    assert (label in scanner().scan(text)[5].split(",")) if label else scanner().scan(text)[5] == ""


def test_licence_table(spark):
    rows = [(0, "a MIT License b mit license", "z"), (1, None, None), (2, "", "z"), (0, "a MIT License b mit license", "z"), (None, "w " * 50_000 + "cc by", "z")]
    out = licence_rules.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string"))
    got = sorted((tuple(r)[:8] for r in out.collect()), key=str)
    assert got == sorted(((i, z, *base_places(t), licence_rules.Scanner().scan(t)[5]) for i, t, z in rows), key=str)
    assert licence_rules.scanned(spark.createDataFrame([], "text string")).count() == 0


def test_marked_words_are_template_and_plain_words(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    marks = ["Tom", "ann", "3", "12.5", "kg", "5kg", " ", " ", " ", "-", "'", "’", ".", ",", "7th", "3rdx", "O'Neil", "É", "é", "İ", "σ", "x", "in", "IN", "\n", "\t", "٣", "Ⅷ", "\xa0", "(", "1/2",
             "iPhone", "$", "\x01", "\x02", "\x03M", "漢", "\u0301", "ǅ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    t = template_leaks
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t.source(F.col("t")).alias("t")).select(
        "t", t.words(t.plain(F.col("t"))).alias("plain"), t.words(t.template(F.col("t"))).alias("template"), F.transform(t.marked_words(F.col("t")), t.plain_of).alias("p"),
        F.transform(t.marked_words(F.col("t")), t.kind_of).alias("k"))
    bad = [r for r in rows.collect() if r["plain"] != r["p"] or r["template"] != r["k"]]
    assert not bad, bad[:3]


# ---- leaks against brute force

VOCABULARY = ["the", "farm", "sold", "apples", "Tom", "Ann", "Bob", "3", "7", "12.5", "kg", "in", "of", "and", "river", "Oslo", "how", "many"]


def plain_words(text):
    return [w for w in (re.sub(r"[^\w]|_", "", x).lower() for x in text.split()) if w]


def placed(words):
    """Kinds of the words (M name, N number, U unit, else the word itself) as the template has them."""
    kinds = []
    for k, w in enumerate(words):
        bare = re.sub(r"[^\w.]|_", "", w).rstrip(".")
        if re.match(r"[A-Z]", bare):
            kinds.append("M")
        elif re.match(r"\d", bare):
            kinds.append("N")
        elif bare.lower() in template_leaks.UNITS and kinds and kinds[-1] == "N":
            kinds.append("U")
        else:
            kinds.append(bare.lower())
    return kinds


def window_meets(item, text, size):
    """Offsets at which some window of an item meets one of a text: all plain words equal, or kinds equal where names may be literal on both sides."""
    a, b = placed(item), placed(text)
    p, q = plain_words(" ".join(item)), plain_words(" ".join(text))
    found = set()
    for i in range(len(a) - size + 1):
        for j in range(len(b) - size + 1):
            if p[i:i + size] == q[j:j + size]:
                found.add((i, j))
    return found


@given(st.lists(st.lists(st.sampled_from(VOCABULARY), min_size=1, max_size=14), min_size=1, max_size=3), st.lists(st.lists(st.sampled_from(VOCABULARY), max_size=20), min_size=1, max_size=6),
       st.data())
@settings(max_examples=3, deadline=None)
def test_word_for_word_leaks_are_all_found(spark, bench, texts, data):
    """Every text that holds the words of an item, of any length, is found; nothing is found in texts without a window of the item; the gate changes nothing."""
    texts = [[*t, *bench[data.draw(st.integers(0, len(bench) - 1))]] if data.draw(st.booleans()) else t for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = items(spark, [(i, " ".join(b)) for i, b in enumerate(bench)])
    runs = [template_leaks.leaks(docs, rows, gate_pairs=most).drop("row_key").collect() for most in (template_leaks.GATE_PAIRS, 0)]
    assert sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))
    got = {}
    for r in runs[0]:
        got.setdefault(r.doc_id, set()).add(r.item_id)
    for d, t in enumerate(texts):
        folded = " " + " ".join(plain_words(" ".join(t))) + " "
        whole = [i for i, b in enumerate(bench) if " " + " ".join(plain_words(" ".join(b))) + " " in folded]
        for i in whole:  # items of one template are one, the smallest id stands for them
            assert any(placed(bench[k]) == placed(bench[i]) for k in got.get(d, ())), (d, i)
        for k in got.get(d, ()):
            size = min(len(bench[k]), template_leaks.WINDOW)
            twins = [b for b in bench if placed(b) == placed(bench[k])]
            literal = [x for x in placed(t) if x not in "MNU"]
            assert any(window_meets(b, t, size) for b in twins) or len({x for x in placed(bench[k]) if x not in "MNU"} & {*literal, *plain_words(" ".join(t))}) > 0
