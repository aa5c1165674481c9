"""Fill-in-the-middle, WARC archives and token links against plain Python."""

import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktab.llm import middle_blocks, token_links, warc_files
from sparktab.session import scratch_path

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- fill in the middle


def plainly_moved(text, key, rate=100, spm=50):
    text = text or ""
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    lines = [x for x in lines if x]
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\n\nb\n", "<P> in text\nx", "ends <\nP>\n<", "é\n漢字\n😀 b\nlast", "<S\n>\n<M\nM>", "x" * 200_000 + "\n" + "y" * 5,
    "\n".join(f"line {i} é" for i in range(30_000)), "\r\nkeeps\r\n\0\n",
]


def test_blocks_move_as_strings_do(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] * 2 + [(None, "a\nb\nc"), (-5, "a\nb\nc")]
    for rate, spm in ((100, 50), (40, 100), (0, 0)):
        moved = middle_blocks.rearranged(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate, spm_rate=spm)
        got = middle_blocks.restored(moved).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly_moved(r["text"], "" if r["doc_id"] is None else r["doc_id"], rate, spm)
            assert r["restored"] == (r["text"] or "")


def test_blocks_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a\nb", "k", 3)], "doc_id long, text string, output string, form int")
    out = middle_blocks.rearranged(df)
    assert out.columns == ["doc_id", "text", "output", "form", "n", "form", "prefix_chars", "middle_chars", "output"] and len(out.collect()) == 1
    assert middle_blocks.rearranged(df.limit(0).select("doc_id", "text")).count() == 0


def test_other_sentinels_and_bad_ones(spark):
    df = spark.createDataFrame([(i, "a\nbc\nd\n") for i in range(40)], "doc_id long, text string")
    marks = ("<pre>", "<suffix>", "<mid>")
    got = middle_blocks.restored(middle_blocks.rearranged(df, sentinels=marks), sentinels=marks).collect()
    assert {r["restored"] for r in got} == {"a\nbc\nd\n"} and {r["form"] for r in got} == {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle_blocks.rearranged(df, sentinels=bad)


def test_rotation_in_blocks():
    import numpy as np

    for size, cut in ((10, 3), (middle_blocks.REVERSED * 3 + 17, 5), (middle_blocks.REVERSED * 2, middle_blocks.REVERSED + 1), (4, 0), (4, 4)):
        raw = np.random.default_rng(size).integers(0, 256, size, np.uint8)
        view = raw.copy()
        middle_blocks.rotate(view, 0, cut, size)
        assert (view == np.concatenate([raw[cut:], raw[:cut]])).all()


# ---- archives


def written(spark, rows, schema="page_id long, url string, html string", **options):
    path = scratch_path(spark, "warc-test")
    warc_files.write_archives(spark.createDataFrame(rows, schema), path, **options)
    return path


def files_of(spark, path):
    return [bytes(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()]


LONG = "<p>" + "word " * 400
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (3, None, "short"), (4, "http://a/4", "short"), (5, "http://a/ 5\r\nX: y", None),
    (6, "http://a/é", ""), (7, "u", "é" * 499), (8, "u", "é" * 499), (10, "u", "é" * 500), (11, "u", "é" * 500), (None, "n", LONG), (12, "big", "z" * 3_000_000),
]


@pytest.mark.parametrize("options", [{}, {"broadcast_payloads": 0}, {"archive_bytes": 500}])
def test_pages_come_back(spark, options):
    path = written(spark, PAGES, **options)
    got = warc_files.read_archives(spark, path, payloads=True).collect()
    assert all(r["problem"] is None for r in got)
    rows = {r["page_id"]: r for r in got if r["record_type"] != "warcinfo"}
    assert len(rows) == len(PAGES)
    tops = defaultdict(list)
    for page, _, html in PAGES:
        if len((html or "").encode()) >= 1000:
            tops[html].append(page)
    for page, url, html in PAGES:
        r, raw = rows[None if page is None else str(page)], (html or "").encode()
        top = max((p for p in tops.get(html, []) if p is not None), default=page)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == page else ("revisit", str(top)))
        assert r["payload"] == (raw if top == page else None)
        if top != page:
            assert r["refers_to_id"] == rows[str(top)]["record_id"]
    assert len({r["record_id"] for r in got if r["record_type"] != "warcinfo"}) == len(PAGES)


def test_each_record_is_a_gzip_member(spark):
    path = written(spark, PAGES, archive_bytes=3000)
    n = 0
    for raw in files_of(spark, path):
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while raw:
            unpack = zlib.decompressobj(31)
            assert unpack.decompress(raw).startswith(b"WARC/1.1\r\n") and unpack.eof
            raw, n = unpack.unused_data, n + 1
    assert n == len(PAGES) + len(files_of(spark, path))


def test_a_record_past_16_mb_leaves_padding(spark):
    path = written(spark.sparkContext and spark, [(1, "u", "a" * (17 << 20)), (2, "u", "b")])
    got = warc_files.read_archives(spark, path).where("record_type = 'response'").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["problem"]) for r in got) == [("1", 17 << 20, None), ("2", 1, None)]


def test_ties_of_the_largest_id_and_only_nulls(spark):
    got = warc_files.read_archives(spark, written(spark, [(7, "a", LONG), (7, "a", LONG), (7, "b", LONG), (3, "c", LONG), (None, "d", LONG * 2), (None, "e", LONG * 2)]))
    rows = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got.where("record_type != 'warcinfo'").collect())
    assert rows == {("7", "response", None): 3, ("3", "revisit", "7"): 1, (None, "response", None): 2}


def test_no_pages(spark):
    path = written(spark, [])
    assert warc_files.read_archives(spark, path).count() == 0


def damaged(raw):
    return [(r["place"], r.get("page_id"), r["problem"]) for r in warc_files.records_of(memoryview(raw), False)]


def test_damage_is_told_and_passed():
    one, two, three = (warc_files.page_member(str(k), "u", b"payload %d" % k * 50, None) for k in range(3))
    assert [p for _, p, _ in damaged(one + two + three)] == ["0", "1", "2"]
    assert damaged(one + two[:40] + three)[1:] == [(len(one), None, "compressed data is broken"), (len(one) + 40, "2", None)]
    assert damaged(one + two[:-9])[1][2] == "archive ends inside a record"
    assert [x for _, _, x in damaged(one + b"\0\0" + two)] == [None, None]
    assert damaged(b"junk" + one)[0][2] == "compressed data is broken" and damaged(b"junk" + one)[1] == (4, "0", None)
    head = lambda n, body, more="": gzip.compress(f"WARC/1.1\r\nWARC-Type: resource\r\n{more}Content-Length: {n}\r\n\r\n{body}\r\n\r\n".encode())
    assert damaged(head(4, "body"))[0][2] is None
    assert damaged(head(9, "body"))[0][2] == "record is shorter than its Content-Length" and damaged(head(2, "body"))[0][2] == "record is longer than its Content-Length"
    assert damaged(head(4, "body", "WARC-Block-Digest: sha1:" + "A" * 32 + "\r\n"))[0][2] == "block digest differs"
    assert damaged(gzip.compress(b"no record"))[0][2] == "no record head"
    wrong = gzip.decompress(one).replace(b"payload 0", b"payload 9")
    assert damaged(gzip.compress(wrong))[0][2] == "block digest differs"


# ---- token links


def plainly_linked(rows):
    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    pair = token_links.Pair(*PATHS)
    tokens_a = [pair.a.blob[pair.a.offsets[i]:pair.a.offsets[i + 1]].tobytes() for i in range(pair.a.size)]
    tokens_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in range(pair.b.size)]
    found = []
    for _, text in rows:
        groups = []
        if text:
            a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
            want = (" " + text).encode()
            if b"".join(tokens_a[i] for i in a) == want == b"".join(tokens_b[i] for i in b):
                a_at = b_at = ia = ib = 0
                group = ([], [])
                while ia < len(a) or ib < len(b):
                    if a_at <= b_at and ia < len(a):
                        a_at += len(tokens_a[a[ia]])
                        group[0].append(a[ia])
                        ia += 1
                    else:
                        b_at += len(tokens_b[b[ib]])
                        group[1].append(b[ib])
                        ib += 1
                    if a_at == b_at:
                        groups.append(group)
                        group = ([], [])
        found.append(groups)
    counts, best = Counter(), Counter()
    for groups in found:
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), groups in zip(rows, found):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  two  blanks", "\n\n\n", "▁ mark", "é not composed", "ﬁ ligature", "<s> </s> <unk> <|endoftext|> <0x41>", "ﬁ", "漢字かな交じり文", "😀😀👨‍👩‍👧", "tab\there", "\0 nul",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "trailing ", "The same text", "The same text", "The same text", "naïve café", "  hard", "Ünïcödé " * 300, "مرحبا بالعالم", "​zero",
]


def test_links_follow_the_plain_way(spark, sf):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "The same text"), (None, None), (3, "The same text")]
    rows += [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plainly_linked(rows)
    for chunk_bytes in (token_links.CHUNK_BYTES, 20_000):
        got = token_links.measured(docs, *PATHS, chunk_bytes=chunk_bytes).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_links_of_common_texts_are_joined_by_broadcast_too(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "Two thirds say this").otherwise(F.concat(F.lit("Row "), "id")).alias("text"), F.lit("k").alias("n_a"))
    out = token_links.measured(docs, *PATHS)
    assert out.columns[:2] == ["doc_id", "n_a"] and out.count() == 3000
    got = out.toDF("doc_id", "mine", *out.columns[2:]).groupBy("mine").agg(F.countDistinct("doc_id").alias("n"), F.max("count_sum").alias("most")).collect()
    assert [(r["mine"], r["n"], r["most"] > 2000) for r in got] == [("k", 3000, True)]
    assert token_links.measured(docs.limit(0), *PATHS).count() == 0


def test_links_in_small_blocks_are_the_same(monkeypatch):
    pair = token_links.Pair(*PATHS)
    texts = [t for t in ODD if t] + ["some more words to align " * 40]
    whole = token_links.aligned_texts(pair, texts)
    monkeypatch.setattr(token_links, "BLOCK", 3)
    assert token_links.aligned_texts(pair, texts) == whole


def test_words_are_cut_as_whole_texts_are(sf, spark):
    import random

    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    rng = random.Random(5)
    marks = ["a", "b", "word", " ", " ", "  ", "\n", "\t", "é", "é", "ﬁ", "´", "漢", "😀", "<s>", "▁", "0", "12", "'s", "\u3000", "\xa0", ".", "\0", "\u200b"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text != ''").select("text").collect()] + [t for t in ODD if t]
    side = token_links.piece_side(PATHS[1])
    assert side.encode.by_word
    wanted = [b" " + t.encode() for t in texts]
    got, whole = side.encode(texts), model.encode(texts, num_threads=1)
    same = token_links.both_equal(side, got, wanted)
    assert (same == token_links.both_equal(side, [np.array(x) for x in whole], wanted)).all() and same.sum() > 5000
    assert all(g.tolist() == w for g, w, s in zip(got, whole, same) if s)


def test_pieces_are_cut_as_texts_are(sf, spark):
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text != ''").select("text").collect()] + [t for t in ODD if t]
    got = token_links.byte_side(PATHS[0]).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
