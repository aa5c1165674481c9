"""Benchmark decontamination by templates, in DataFrame functions only.

Texts become templates: numbers, units after numbers, and names (capitalised words, wherever they stand) turn into typed placeholders, other
words are lower-cased, punctuation is dropped. Windows of template words are hashed and joined with the windows of the benchmark's items.
Whether a capitalised word is a name or begins a sentence can't be told from what stands before it, so it has both readings: a window of an
item is asked for in every reading of its capitalised words, a window of a text has a reading in which all are names and, for each of them,
one in which that word is literal. Plain lower-cased windows are joined as well, those full of slots too, so word-by-word copies are found
whatever their case.

Windows that agree at one offset between text and item are one alignment. Alignments whose offsets lie near each other (less than
``DRIFT`` / 2 words always, less than ``DRIFT`` words by chance of place) are summed, so a name of more words or a word put in doesn't split an
item. They are a leak if together they cover at least ``min_cover`` of the item's words and the slots are consistent: each value that a slot
of the item has stands for one value in the text, so a question with other numbers or names is caught, while a chance mixture of values is
not. Names are compared inside one alignment, where their number of words agrees; numbers and units across the sum; if these disagree, the
best alignment counts alone. Plain windows that cover ``min_cover`` of an item are a leak whatever the slots beside them.

Items of fewer words than a window are matched by one window of their length. Items of fewer than ``MIN_WORDS`` words, and windows of which less
than half the words are literal, match word by word only. Items with equal templates (placeholders, sentence starts and places of
equal values) are one; the smallest id stands for them, ``n_items`` counts them.

A text's window is hashed only if each pair of neighbouring lower-case words in it stands in the benchmark: such words are literal in every reading.
The pairs are literals up to ``GATE_PAIRS`` counted ones; beyond that all windows are hashed, with the same result. Template and plain words of a text
come out of one pass in which placeholders stand around the words they replace. Steps on the few rows that are left are dealt out by counted
rows, since each row is dear.

The benchmark's windows are broadcast only if they number at most ``BROADCAST_WINDOWS`` (40 bytes each), else both sides are shuffled by the
hash. Null and empty texts have no windows. Rows that repeat id and text give one result. Empty tables give an empty result. Other columns
of the texts pass through ``remove_leaks``, whatever their names; ids may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

WINDOW = 8
MIN_WORDS = 4
MIN_COVER = 0.5
#: Offsets summed together lie in one stretch of so many words; stretches overlap by half.
DRIFT = 16
#: Pairs of the benchmark's neighbouring words that are held as literals.
GATE_PAIRS = 100_000
#: Rows of a task where each row is worth milliseconds.
DEAR_ROWS = 500
BROADCAST_WINDOWS = 500_000

# Units of measure (fixed values), as they stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g mg kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit hz khz mhz ghz w kw mw watt watts v volt volts a amp amps "
    "b kb mb gb tb byte bytes bit bits mph kmh kph j kj cal kcal n pa kpa people times"
).split()


def plain(text: Column) -> Column:
    """Words without punctuation, lower-cased, between single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\s\x01]+", "")), r"\s+", " "))


NAME = r"(?<![\p{L}\p{M}\p{N}'’-])\p{Lu}[\p{L}\p{M}'’-]*"
#: Names but for the first word of a sentence or line; tells items apart, matches nothing.
INNER_NAME = r"\p{Lu}(?<=[^\s.!?:;|][ \t]{1,4}\p{Lu})[\p{L}\p{M}'’-]*"


NUMBER = r"\p{Nd}[\p{Nd}]*(?:[.,:/]\p{Nd}+)*(?:(?:st|nd|rd|th)(?![\p{L}\p{M}]))?"


def template(text: Column, name: str = NAME) -> Column:
    """``plain`` with placeholders: as many words, each in its place."""
    named = F.regexp_replace(text, name, "\x01M")
    counted = F.regexp_replace(named, NUMBER, "\x01N")
    return plain(F.regexp_replace(counted, rf"(\x01N[ \t]{{0,2}})(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}\p{{N}}])", "$1\x01U"))


def marked_words(text: Column) -> Column:
    """Plain words with the parts that ``template`` replaces between a placeholder and a closing sign."""
    named = F.regexp_replace(text, NAME, "\x01M$0\x02")
    counted = F.regexp_replace(named, NUMBER, "\x01N$0\x03")
    measured = F.regexp_replace(counted, rf"(\x03[ \t]{{0,2}})((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{M}}\p{{N}}])", "$1\x01U$2\x02")
    return words(F.regexp_replace(F.lower(F.regexp_replace(measured, r"[^\p{L}\p{M}\p{N}\s\x01-\x03]+", "")), r"\s+", " "))


def kind_of(word: Column) -> Column:
    """The template's word of a marked one."""
    return F.when(is_slot(word), F.regexp_replace(word, r"\x01([mnu])[^\x02\x03]*[\x02\x03]", "\x01$1")).otherwise(word)


def plain_of(word: Column) -> Column:
    """The plain word of a marked one."""
    return F.when(is_slot(word), F.regexp_replace(word, r"\x01[mnu]|[\x02\x03]", "")).otherwise(word)


def source(text: Column) -> Column:
    """The text without the signs of placeholders."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x01\x02\x03", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def hashed(kinds: Column) -> Column:
    return F.transform(kinds, lambda w: F.xxhash64(w))


def is_slot(word: Column) -> Column:
    return word.contains("\x01")


def joined(hashes: Column, size: int, at: Column | None = None) -> Column:
    """The hash of the window of ``size`` word hashes at a place."""
    return F.xxhash64(*(F.get(hashes, k if at is None else at + k) for k in range(size)))


def starts(words_: Column, size: int) -> Column:
    """Where windows begin; empty for fewer words than ``size``."""
    return F.when(F.size(words_) >= size, F.sequence(F.lit(0), F.size(words_) - size)).otherwise(F.array().cast("array<int>"))


def readings(size: int) -> Column:
    """Hashes of all readings of a window: ``kinds``, ``h`` (hashes of template words), ``p`` (of plain words) are its words; at least half are literal."""
    return F.array_distinct(F.transform(F.filter(F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)), F.array(F.struct(F.lit(0).alias("slots"), F.array().cast("array<bigint>").alias("r"))),
        lambda found, i: F.flatten(F.transform(found, lambda x: F.when(
            ~is_slot(F.get("kinds", i)), F.array(F.struct(x["slots"].alias("slots"), F.concat(x["r"], F.array(F.get("p", i))).alias("r")))
        ).when(F.get("kinds", i) != "\x01m", F.array(F.struct((x["slots"] + 1).alias("slots"), F.concat(x["r"], F.array(F.get("h", i))).alias("r")))).otherwise(F.array(
            F.struct((x["slots"] + 1).alias("slots"), F.concat(x["r"], F.array(F.get("h", i))).alias("r")),
            F.struct(x["slots"].alias("slots"), F.concat(x["r"], F.array(F.get("p", i))).alias("r")),
        )))),
    ), lambda x: x["slots"] * 2 <= size), lambda x: joined(x["r"], size)))


def asked_windows(kinds: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """hash, item_key, item_at, size, lane: null for templates, a number of the item's own words for plain windows."""
    at = kinds.join(items.where(F.col("size") == size).select("item_key"), "item_key")
    at = at.select("item_key", "words", F.col("kinds").alias("all"), F.xxhash64("words").alias("lane"), F.explode(starts(F.col("kinds"), size)).alias("item_at"))
    own = at.select("item_key", "item_at", "lane", F.slice("all", F.col("item_at") + 1, F.lit(size)).alias("kinds"), F.slice("words", F.col("item_at") + 1, F.lit(size)).alias("words"))
    own = own.withColumns({"h": hashed(F.col("kinds")), "p": hashed(F.col("words"))})
    none = F.lit(None).cast("bigint")
    shape = lambda rows, lane, *hashes: rows.select(*(hashes or ["hash"]), "item_key", "item_at", F.lit(size).alias("size"), lane.alias("lane"))
    some = own.dropDuplicates(["item_key", "item_at", "kinds", "p"]).where(F.lit(size >= MIN_WORDS))
    exact = own.select("item_key", "item_at", "lane", joined(F.col("p"), size).alias("hash"))
    return shape(some, none, F.explode(readings(size)).alias("hash")).unionAll(shape(exact, none)).distinct().unionAll(shape(exact, F.col("lane")))


def pairs_of(rows: DataFrame, most: int) -> list[int] | None:
    """Hashes of the neighbouring plain words of all items; None for more than ``most``."""
    pair = F.transform(F.slice("words", F.lit(2), F.size("words") - 1), lambda w, i: F.xxhash64(F.xxhash64(F.get("words", i)), F.xxhash64(w)))
    found = rows.select(F.explode(pair).alias("pair")).distinct().limit(most + 1).collect()
    return [r["pair"] for r in found] if len(found) <= most else None


def gated(rows: DataFrame, pairs: list[int] | None) -> DataFrame:
    """``open``: whether a window may hold the word at a place and the next one. ``rows``: kinds, h."""
    if pairs is None:
        return rows.withColumn("open", F.transform("kinds", lambda w: F.lit(True)))
    either = F.transform("kinds", lambda w, i: F.when(~is_slot(w) & ~is_slot(F.coalesce(F.get("kinds", i + 1), F.lit("\x01"))), F.xxhash64(F.get("h", i), F.get("h", i + 1))))
    known = ", ".join(f"{x}L" if x > -1 << 63 else "bigint('-9223372036854775808')" for x in pairs) or "NULL"
    return rows.withColumn("pair", either).withColumn("open", F.expr(f"transform(pair, x -> x IS NULL OR coalesce(x IN ({known}), false))")).drop("pair")


def text_windows(kinds: Column, h: Column, p: Column, opened: Column, size: int) -> Column:
    """(at, hash) of each window: all capitalised words as names, each one of them as literal, and all words plain."""
    def at_place(i):
        own = F.slice(kinds, i + 1, F.lit(size))
        slots = F.size(F.filter(own, is_slot))
        one = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.get(kinds, i + k) == "\x01m"))
        single = F.transform(one, lambda k: F.xxhash64(*(F.when(k == j, F.get(p, i + j)).otherwise(F.get(h, i + j)) for j in range(size))))
        none = F.array().cast("array<bigint>")
        found = F.when(slots == 0, F.array(joined(h, size, i))).otherwise(F.concat(
            F.array(joined(p, size, i)), F.when(slots * 2 <= size, F.array(joined(h, size, i))).otherwise(none),
            F.when((slots - 1) * 2 <= size, single).otherwise(none),
        ))
        return F.transform(found, lambda x: F.struct(i.alias("at"), x.alias("hash")))

    def may(i):
        passes = F.lit(True)
        for k in range(size - 1):
            passes = passes & F.get(opened, i + k)
        return passes

    return F.flatten(F.transform(F.filter(starts(kinds, size), may), at_place))


def covered(ats: Column) -> Column:
    """Words that windows at sorted places cover; ``size`` is the window's."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ats)), F.lit(0), lambda s, i: s + F.when(i == F.size(ats), F.col("size")).otherwise(
        F.least(F.col("size"), F.get(ats, i) - F.get(ats, i - 1))))


def together(parts: Column) -> Column:
    """The places of windows of all alignments, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda x: x["ats"]))))


def agree(pairs: Column) -> Column:
    """Whether each value of the item stands for one value of the text."""
    kinds = F.array_distinct(F.transform(pairs, lambda x: F.struct(x["item"], x["text"])))
    return F.size(kinds) == F.size(F.array_distinct(F.transform(pairs, lambda x: x["item"])))


def small_side(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one number, broadcast if there are at most ``most`` of them."""
    return F.broadcast(rows) if rows.count() <= most else rows


def item_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words (plain), kinds (template) and item_key, which equal templates share."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), source(F.col(text)).alias("text")).select(
        "item_id", F.transform(marked_words(F.col("text")), plain_of).alias("words"), F.transform(marked_words(F.col("text")), kind_of).alias("kinds"),
        words(template(F.col("text"), INNER_NAME)).alias("inner"),
    ).where(F.size("kinds") > 0)
    first = F.transform("inner", lambda w, i: F.when(is_slot(w), F.array_position("words", F.get("words", i))).otherwise(F.lit(0)))
    return rows.select("item_id", "words", "kinds", F.xxhash64("kinds", "inner", first).alias("item_key"))


def items_of(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each template of ``item_words``: item_key, item_id, n_items, words (plain), kinds (template), n, size (its window)."""
    return rows.groupBy("item_key").agg(
        F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"), F.min(F.struct(F.col("item_id").isNull(), "item_id", "words", "kinds")).alias("x")
    ).select(
        "item_key", "item_id", "n_items", "x.words", "x.kinds", F.size("x.kinds").alias("n"), F.least(F.size("x.kinds"), F.lit(window)).alias("size")
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, min_cover: float = MIN_COVER, broadcast_windows: int = BROADCAST_WINDOWS,
    gate_pairs: int = GATE_PAIRS,
) -> DataFrame:
    """row_key, doc_id, item_id, n_items, n_words (of the item), n_covered, n_slots, n_changed (slots with another value)."""
    every = cut_lineage(item_words(benchmark, item_id, item_text))
    items = cut_lineage(items_of(every, window))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most window values
    distinct_words = every.select("item_key", "words", "kinds").dropDuplicates(["item_key", "words"])
    asked = None
    for size in sizes or [window]:
        own = asked_windows(distinct_words, items, size)
        asked = own if asked is None else asked.unionAll(own)
    asked = cut_lineage(asked)
    n_asked = asked.count()
    texts = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).alias("doc_id"), source(F.col(text)).alias("text"))
    marked = texts.select("row_key", marked_words(F.col("text")).alias("marked")).select("row_key", "marked", F.transform("marked", kind_of).alias("kinds"))
    marked = marked.select("row_key", "marked", "kinds", hashed(F.col("kinds")).alias("h"))
    own = F.transform("marked", lambda w, i: F.when(is_slot(w), F.xxhash64(plain_of(w))).otherwise(F.get("h", i)))
    marked = gated(marked.select("row_key", "kinds", "h", own.alias("p")), pairs_of(distinct_words, gate_pairs))
    of_size = lambda n: F.transform(text_windows(F.col("kinds"), F.col("h"), F.col("p"), F.col("open"), n), lambda x: F.struct(x["at"], x["hash"], F.lit(n).alias("size")))
    found = marked.select("row_key", F.explode(F.concat(*map(of_size, sizes or [window]))).alias("x")).select("row_key", "x.at", "x.hash", "x.size")
    side = F.broadcast(asked) if n_asked <= broadcast_windows else asked
    hits = found.join(side, ["hash", "size"]).select("row_key", "item_key", "lane", (F.col("at") - F.col("item_at")).alias("shift"), "item_at")
    aligned = cut_lineage(hits.groupBy("row_key", "item_key", "lane", "shift").agg(F.sort_array(F.collect_set("item_at")).alias("ats")))  # at most the item's words
    tasks = max(1, -(-aligned.count() // DEAR_ROWS))
    stretch = F.array(F.floor(F.col("shift") / DRIFT) * 2, F.floor((F.col("shift") + DRIFT // 2) / DRIFT) * 2 + 1)
    near = aligned.repartition(tasks, "row_key").select("*", F.explode(stretch).alias("stretch")).groupBy("row_key", "item_key", "lane", "stretch").agg(
        F.collect_list(F.struct("shift", "ats")).alias("parts")  # at most DRIFT
    ).join(items, "item_key")
    long = cut_lineage(near.withColumn("n_covered", covered(together(F.col("parts")))).where(F.col("n_covered") >= min_cover * F.col("n")))
    tasks = max(1, -(-long.count() // DEAR_ROWS))
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: is_slot(F.get("kinds", i)) & F.exists(together(F.col("parts")), lambda a: (a <= i) & (i < a + F.col("size"))))
    keys = small_side(long.select("row_key").distinct(), broadcast_windows)
    own = texts.join(keys, "row_key", "left_semi").select("row_key", "doc_id", words(plain(F.col("text"))).alias("own")).dropDuplicates(["row_key"])
    both = cut_lineage(long.join(own, "row_key").repartition(tasks, "row_key"))
    shape = ("row_key", "item_key", "doc_id", "item_id", "n_items", F.col("n").alias("n_words"), "n_covered")
    exact = both.where(F.col("lane").isNotNull()).select(*shape, F.size(places).alias("n_slots"), F.lit(0).alias("n_changed"))
    spots = lambda x: F.filter(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: is_slot(F.get("kinds", i)) & F.exists(x["ats"], lambda a: (a <= i) & (i < a + F.col("size"))))
    paired = F.transform("parts", lambda x: F.struct(x["shift"].alias("shift"), x["ats"].alias("ats"), F.transform(spots(x), lambda i: F.struct(
        i.alias("at"), F.get("words", i).alias("item"), F.get("own", x["shift"] + i).alias("text"), F.get("kinds", i).alias("kind"))).alias("pairs")))
    checked = cut_lineage(both.where(F.col("lane").isNull()).withColumn("parts", F.filter(paired, lambda x: agree(x["pairs"])))).where(F.size("parts") > 0)
    numbers = F.filter(F.flatten(F.transform("parts", lambda x: x["pairs"])), lambda x: x["kind"] != "\x01m")
    alone = F.slice(F.reverse(F.array_sort(F.transform("parts", lambda x: F.struct(covered(x["ats"]).alias("c"), (-x["shift"]).alias("s"), x.alias("x"))))), 1, 1)
    checked = checked.withColumn("parts", F.when(agree(numbers), F.col("parts")).otherwise(F.transform(alone, lambda x: x["x"])))
    checked = cut_lineage(checked.withColumn("n_covered", covered(together(F.col("parts")))).where(F.col("n_covered") >= min_cover * F.col("n")))
    checked = checked.withColumn("pairs", F.flatten(F.transform("parts", lambda x: x["pairs"])))
    spot = F.array_distinct(F.transform("pairs", lambda x: x["at"]))
    same = F.transform(F.filter("pairs", lambda x: x["item"].eqNullSafe(x["text"])), lambda x: x["at"])
    changed = checked.select(*shape, F.size(spot).alias("n_slots"), F.size(F.array_except(spot, same)).alias("n_changed"))
    best = exact.unionAll(changed).groupBy("row_key", "item_key").agg(F.max_by(
        F.struct("doc_id", "item_id", "n_items", "n_words", "n_covered", "n_slots", "n_changed"), F.struct("n_covered", -F.col("n_changed"), "n_slots")).alias("x"))
    return best.select("row_key", "x.*")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark item."""
    names = docs.columns
    plain_names = docs.toDF(*(f"x{i}" for i in range(len(names))))
    at_id, at_text = f"x{names.index(doc_id)}", f"x{names.index(text)}"
    gone = small_side(cut_lineage(leaks(plain_names, benchmark, at_id, at_text, **options).select("row_key").distinct()), BROADCAST_WINDOWS)
    kept = plain_names.withColumn("row_key", F.xxhash64(at_id, at_text)).join(gone, "row_key", "left_anti")
    return kept.select(*(f"x{i}" for i in range(len(names)))).toDF(*names)
