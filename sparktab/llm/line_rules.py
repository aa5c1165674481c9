"""Line-first cleaning: rules per line, failing lines removed, then texts rejected that fail the base rules or lose too much.

A line is what stands between two \\n. A line without words stays and counts for nothing. A line fails if one rule holds:

* symbols: at least 3 of the characters ``#*$%&|<>``, and more than 0.3 for each word
* navigation: at least 3 separators (``|``, ``>``, ``»``, ``›``, ``•``, ``·``), and more than 0.2 for each word
* shouting: at least 20 ASCII letters, more than 0.7 of them capital, in at least 5 words
* punctuation: at least 12 words without any of ``.,;:!?`` or another sentence mark, or 1 to 7 words that don't end with one of them
* boilerplate: a phrase of page furniture in a line of at most 25 words
* repetition: at least 10 words of which fewer than 0.2 are distinct
* copy: at least 3 words, equal to an earlier line of the text

A text is rejected if it has fewer than 50 words, if more than half of its words stand in repeated 3-word windows, or if the lines that stay have
less than ``min_left`` of its words.

Null text has no words and is rejected; it stays null. Empty text is rejected too. Repeated rows are judged each for itself, equal rows
alike. An empty table gives an empty result. Other columns pass through under their names, whatever these are.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .words import byte_table, flat, mix, words_of

MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Share of a text's words that must stand in lines that stay.
MIN_LEFT = 0.6
SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept all cookies", "add to cart", "all rights reserved", "back to top", "by using this site", "click here", "cookie policy", "cookies to improve",
    "create an account", "enable javascript", "follow us on", "forgot your password", "javascript is disabled", "javascript is required", "leave a comment",
    "leave a reply", "lorem ipsum", "newsletter signup", "next page", "powered by", "previous page", "privacy policy", "read more", "related articles",
    "related posts", "requires javascript", "share on facebook", "share on twitter", "share this", "sign in to", "sign up for", "skip to content",
    "skip to main", "subscribe to our", "terms of service", "terms of use", "use of cookies", "view all posts", "your browser does not support",
)
METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_left bigint, base_failed boolean, kept boolean"


def _count(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes in the table between neighbouring bounds."""
    sums = np.concatenate([[0], np.cumsum(table[raw])])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated_words(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int = 3) -> np.ndarray:
    """For each text, its words that stand in a window that the same text has twice or more."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    key = mix(text[:n].astype(np.uint64))
    for k in range(size):
        key = mix(key + hashes[k:n + k])
    at = np.flatnonzero(text[:n] == text[size - 1:])
    order = np.argsort(key[at], kind="stable")
    key = key[at][order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    again[:-1] |= again[1:]
    covered = np.zeros(len(hashes), bool)
    for k in range(size):
        covered[at[order[again]] + k] = True
    return np.bincount(text[covered], minlength=n_texts)


def measure(column: pa.Array, automaton) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base numbers of each text, and the bounds, texts and verdicts of all lines."""
    raw, offs = flat(column)
    n = len(offs) - 1
    words = words_of(raw, offs)
    text = words.texts()
    n_words = np.diff(words.first)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word_chars = np.bincount(text, weights=chars[words.ends] - chars[words.starts], minlength=n).astype(np.int64)
    symbols = byte_table(SYMBOLS)

    breaks = np.flatnonzero(raw == 10)
    # the lines of each text in order: one from its start, one after each of its breaks
    owner = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    order = np.lexsort((np.concatenate([offs[:-1], breaks + 1]), owner))
    begins, line_text = np.concatenate([offs[:-1], breaks + 1])[order], owner[order]
    last = np.append(line_text[1:] != line_text[:-1], True) if len(line_text) else np.zeros(0, bool)
    stops = np.where(last, offs[line_text + 1], np.append(begins[1:], 0) - 1) if len(line_text) else np.zeros(0, np.int64)
    edges = np.searchsorted(words.starts, begins)
    line_words = np.searchsorted(words.starts, stops) - edges
    line = np.repeat(np.arange(len(begins)), line_words)

    def inside(table):
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return sums[stops] - sums[begins]

    has = line_words > 0
    n_symbol = inside(symbols)
    capital, small = np.zeros(256, bool), np.zeros(256, bool)
    capital[65:91], small[97:123] = True, True
    n_capital, n_small = inside(capital), inside(small)
    # two-byte separators » (C2 BB) and · (C2 B7), three-byte › (E2 80 BA) and • (E2 80 A2)
    marks = (raw == ord("|")) | (raw == ord(">"))
    if len(raw) > 1:
        marks[1:] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0xBB) | (raw[1:] == 0xB7))
    if len(raw) > 2:
        marks[2:] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & ((raw[2:] == 0xBA) | (raw[2:] == 0xA2))
    sums = np.concatenate([[0], np.cumsum(marks)])
    n_marks = sums[stops] - sums[begins]
    # sentence marks: ASCII ones; beyond ASCII the quotes, the ellipsis and the full-width ones count as any general punctuation does
    sentence = byte_table(b".,;:!?")
    n_sentence = inside(sentence) + inside(byte_table(bytes([0xE2, 0xE3, 0xEF])))
    ends = np.zeros(len(begins), bool)
    final = words.ends[edges[has] + line_words[has] - 1] - 1
    wide = np.zeros(len(final), bool)
    for back in (1, 2):
        wide |= (raw[np.maximum(final - back, 0)] >= 0xE2) & (raw[final] >= 0x80)
    ends[has] = byte_table(b".,;:!?\"')]}")[raw[final]] | wide

    phrase = np.zeros(len(begins), bool)
    lower = raw.copy()
    lower[capital[raw]] |= 0x20
    hits = [end for end, _ in automaton.iter(lower.tobytes().decode("latin-1"))]
    if hits:
        phrase[np.searchsorted(begins, hits, "right") - 1] = True

    distinct = np.zeros(len(begins), np.int64)
    copy = np.zeros(len(begins), bool)
    if len(line):
        key = mix(words.hashes ^ mix(line.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        distinct = np.bincount(line[order][new], minlength=len(begins))
    data = raw.tobytes()
    seen: set = set()
    now = -1
    for i in np.flatnonzero(has).tolist():
        if line_text[i] != now:
            now = line_text[i]
            seen = set()
        own = data[begins[i]:stops[i]]
        if own in seen:
            copy[i] = True
        else:
            seen.add(own)
    fails = has & (
        ((n_symbol >= 3) & (n_symbol > 0.3 * line_words)) | ((n_marks >= 3) & (n_marks > 0.2 * line_words))
        | ((n_capital + n_small >= 20) & (n_capital > 0.7 * (n_capital + n_small)) & (line_words >= 5))
        | ((line_words >= 12) & (n_sentence == 0)) | ((line_words < 8) & ~ends) | (phrase & (line_words <= 25))
        | ((line_words >= 10) & (distinct < 0.2 * line_words)) | (copy & (line_words >= 3))
    )
    count = lambda mask, weights=None: np.bincount(line_text[mask], weights=None if weights is None else weights[mask], minlength=n).astype(np.int64)
    base = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _count(raw, offs, symbols), "n_dup_lines": count(copy),
        "n_repeat_words": repeated_words(words.hashes, text, n), "n_left": count(~fails, line_words),
    }
    return base, np.stack([begins, stops]), line_text, fails


def phrases():
    automaton = ahocorasick.Automaton()
    for phrase in BOILERPLATE:
        automaton.add_word(phrase, 1)
    automaton.make_automaton()
    return automaton


def judged(docs: DataFrame, text: str = "text", min_left: float = MIN_LEFT, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> DataFrame:
    """All columns of ``docs``, the text without its failing lines, then the METRICS; ``kept`` is the verdict."""
    names = docs.columns
    at = names.index(text)
    source = docs.toDF(*(f"c{i}" for i in range(len(names))))
    source = source.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = StructType([*source.schema.fields, *StructType.fromDDL(METRICS).fields])

    def run(batches):
        automaton = phrases()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                base, bounds, owner, fails = measure(part.column(at), automaton)
                n_words = base["n_words"]
                failed = (n_words < min_words) | (base["n_repeat_words"] > max_repeated * n_words)
                kept = ~failed & (base["n_left"] >= min_left * n_words)
                cut = np.zeros(part.num_rows, bool)
                cut[owner[fails]] = True
                texts = part.column(at).to_pylist()
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i in np.flatnonzero(cut):
                    lines = texts[i].split("\n")
                    texts[i] = "\n".join(x for x, bad in zip(lines, fails[first[i]:first[i + 1]].tolist()) if not bad)
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v) for v in base.values()), pa.array(failed), pa.array(kept)], [f.name for f in schema.fields])

    added = [f.name for f in StructType.fromDDL(METRICS).fields]
    return source.mapInArrow(run, schema).toDF(*names, *added)


def clean(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that are kept, with the columns of ``docs`` and the text cleaned."""
    return judged(docs, text, **options).toDF(*(f"c{i}" for i in range(len(docs.columns))), *(f.name for f in StructType.fromDDL(METRICS).fields)).where("kept").select(
        *(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
