"""Personal data, token alignment and the Merkle manifest against plain versions, with odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sealmark.llm import merkle, pii, token_align


def no_python(df):
    text = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text), text[:500]


# personal data


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    """The base spans as the contract words them."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(nr, m.start(), m.end(), kind) for nr, (kind, pattern, fine) in enumerate(rules) for m in re.finditer(pattern, text or "") if fine(m)]


def iban(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def test_base_spans_against_plain_scan(spark):
    rnd = random.Random(11)
    parts = ["a.b+c@x-y.example.com", "@", ".", "a@b", "a@b.c_d@e.f", "%", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4539578763621486", "1" * 20,
             "0 0", "--", " ", "-", "5", "+1 (555) 010-2030", "+49 30 123456", "+1", "+", ")", "é", "🙂", "\n", "x", "٣", "4" * 13, "+1..2"]
    texts = [None, "", "@" * 50, "."] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "1.2.3.4"), (5, "1.2.3.4"), (5, "1.2.3.4")], "doc_id long, text string")
    df = df.withColumns({"pii": F.lit("old"), "computed_row": F.lit(1), "kind": F.lit(2), "start": F.lit(3)})
    out = pii.find(df)
    no_python(out)
    rows = out.collect()
    assert len(rows) == len(texts) + 3 and set(out.columns) == set(df.columns)
    for r in rows:
        assert [(s.nr, s.start, s.end, s.kind) for s in r.pii if s.nr < 4] == plain_base(r.text), r.text
    assert pii.find(df.limit(0)).collect() == []


def test_checksums_and_context(spark):
    german = iban("DE", "370400440532013000")
    spaced = " ".join(german[i : i + 4] for i in range(0, len(german), 4))
    texts = [
        f"IBAN {german}.", f"pay to {spaced} TODAY OR NEVER", german[:-1] + str((int(german[-1]) + 1) % 10), f"x{german}", f"{german}9", iban("NO", "86011117947"), "ZZ" + german[2:],
        "ssn 536-22-1234", "536-22-1234", "serial 536-22-1234", "my social number is 000-22-1234", "ssn 1536-22-1234", "version 1.2.3.4", "server 1.2.3.4", "call +1 555 010 2030",
    ]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [[(s.kind, r.text[s.start : s.end], s.score) for s in r.pii] for r in rows]
    assert got[0] == [("iban", german, 100)] and got[1] == [("iban", spaced, 90)] and got[2:5] == [[]] * 3
    assert got[5] == [("iban", texts[5], 90)] and got[6] == []
    assert got[7] == [("ssn", "536-22-1234", 60)] and got[8:12] == [[]] * 4
    assert got[12] == [("ip", "1.2.3.4", 40)] and got[13] == [("ip", "1.2.3.4", 80)] and got[14] == [("phone", "+1 555 010 2030", 90)]


def test_redaction(spark):
    texts = [None, "", "é a@b.c and +1 555 010 2030, 1.2.3.4!", "call 4111 1111 1111 1111", "+4222222222222", "nothing"]
    rows = [(i, t, "keep") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = {r.doc_id: (r.text, r.pii_spans) for r in pii.redacted(df).collect()}
    assert [got[i][0] for i in range(6)] == [None, "", "é <EMAIL> and <PHONE>, <IP>!", "call <CARD>", "<PHONE>", "nothing"]
    assert {v[1] for v in got.values()} == {"keep"}


@pytest.mark.parametrize("text,n", [
    ("a" * 400_000, 0), ("1" * 400_000, 0), ("a@" * 200_000, 0), ("a@" + "b." * 200_000, 1), ("1.2.3.4 " * 50_000, 50_000), ("+1 " * 100_000, 0), ("1 " * 200_000, 0), ("+1" + " " * 400_000, 0), ("." * 400_000, 0),
])
def test_long_texts_take_linear_time(spark, text, n):
    began = time.time()
    (r,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("pii").alias("n")).collect()
    assert r.n == n and time.time() - began < 60


# token alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    """Whole texts, decoded bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in visible}
    byte_of |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}
    rows, counts = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            rows.append((0, 0, "", []))
            continue
        groups, links, k, end_a, end_b, one, two = [], [], 0, 0, 0, [], []
        for i, x in zip(ids_a, bytes_a):
            end_a += len(x)
            one.append(i)
            while end_b < end_a:
                two.append(ids_b[k])
                end_b += len(bytes_b[k])
                k += 1
            if end_a == end_b:
                groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, two)))
                links.append((one[-1], two[-1]))
                one, two = [], []
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), ";".join(groups), links))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(n_a, n_b, groups, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)) for n_a, n_b, groups, links in rows]


def hard_texts():
    rnd = random.Random(5)
    parts = ["the", " cat", "  ", " ", "\n", "\t", "é", "straße", "日本語", "🙂", "👩‍👩‍👧", "́", " ", "　", " x", "  ", "<|endoftext|>", "<s>", "</s>", "<0x41>", "'s", "don't", "123", "4 5", "\x00", "\x1c", "\r\n", "𐍈", "ſ", "x", ".", "!?", "▁", "a▁b", "﻿", "​", "ß ", " É", "ÿ ", "\u0085 x"]
    texts = [None, "", " ", "  ", "\n", "▁", "a ", " a", "a  b ", "é ", "🙂 🙂", "<|endoftext|>", "\x00", "a" * 5000, "🙂" * 300]
    return texts + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(700)] + [" ".join(rnd.choice(["of", "the", "word", "été", "naïve,"]) for _ in range(20_000))]


def test_alignment_against_whole_texts(spark):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, groups string, a int").repartition(5)
    got = {r.doc_id: r for r in token_align.align(df, A, B).collect()}
    for i, want in enumerate(plain_alignment(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) == want, texts[i]
        assert r.n_groups == r.n_links
    assert sum(r.n_a > 0 for r in got.values()) > 400
    assert token_align.align(df.limit(0), A, B).collect() == []


def test_alignment_keeps_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other"), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_a, r.count_sum) for r in token_align.align(df, A, B).collect()))
    one, two = (plain_alignment(["same text", "same text", "other", None])[i] for i in (0, 2))
    assert rows == sorted([(1, one[0], one[5]), (1, one[0], one[5]), (-1, two[0], two[5]), (-1, 0, 0)])


def test_units_are_told_anew_when_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_align, "KEPT_UNITS", 40)
    aligner, texts = token_align.Aligner(A, B), [t for t in hard_texts() if t][:60]
    for t, want in zip(texts, plain_alignment(texts)):
        n_a, n_b, groups, *_ = aligner.align(pa.array([t, None], pa.string()))
        assert (n_a[0], n_b[0], groups[0].decode(), n_a[1]) == (*want[:3], 0), t
    # spans alone do for most tokens; the rest are parts of characters and bytes of the fallback
    assert aligner.by_units


# manifest


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(said, r))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, i, now):
        proof = []
        for row in levels[:-1]:
            run = row[i - i % 8 : i - i % 8 + 8]
            proof += run[: i % 8] + run[i % 8 + 1 :]
            now = h(*run[: i % 8], now, *run[i % 8 + 1 :])
            i //= 8
        return proof, now

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in by[g]])
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            now, changed = leaf(r), None
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = changed = leaf((*r[:4], text))
            proof, now = climb(trees[g], i, now)
            upper, now = climb(top, k, now)
            depth = len(trees[g]) + len(top) - 1
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*proof, *upper), changed, now, depth if changed else 0))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "fr": 1}, {"en": 9, None: 64, "é": 3, "z": 65}, {"en": 4096, "de": 4097, None: 2}, {"en": 33_000}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_against_plain_tree(spark, sizes):
    rnd, rows = random.Random(3), []
    for lang, n in sizes.items():
        rows += [(len(rows) + i, rnd.choice(["s", None, "ü"]), lang, rnd.choice([5, None]), rnd.choice(["Text", "", None, "lower", "ÀB"])) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "g": F.lit("y"), "nr": F.lit(1)})
    got = merkle.manifest(df).withColumn("siblings", merkle.digest(F.col("siblings"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(None, "a", "en", 1, "B")] * 2 + [(7, "a", "en", 1, "B"), (7, "a", "en", 1, "C"), (7, "a", "en", 1, "B"), (6, "a", "en", 1, "X" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest(df).withColumn("siblings", merkle.digest(F.col("siblings"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows), key=str)
    assert merkle.manifest(df.limit(0)).collect() == []


def test_versions_share_what_they_do_not_copy():
    tree = merkle.Block([hashlib.sha256(bytes([i])).hexdigest() for i in range(200)], None)
    before = [list(row) for row in tree.levels]
    copied = tree.version(77, "f" * 64)
    assert tree.levels == before and len(copied) == len(before)
    changed = [row[:] for row in before]
    changed[0][77] = "f" * 64
    again = merkle.Block(changed[0], None)
    for level, (old, new, own) in enumerate(zip(before, again.levels, copied)):
        at = 77 // 8**level
        assert new[at] == own and old[:at] + old[at + 1 :] == new[:at] + new[at + 1 :]
