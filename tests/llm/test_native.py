"""Quality rules, chat format, secret scans, line dedup and mixing: defined results of odd cases, and plain versions."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sealmark.llm import chat, line_dedup, mixing, oracles, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def no_python(df):
    text = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text), text[:500]


# quality


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_measures_and_policies(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\x0bx\x0cx x x x", "é ü ß\n# # |\né ü ß\n", "one\n\none\none", "a b a b a b c d"]
    texts += [" ".join(rnd.choice(["aa", "bb", "cc#", "dé"]) + rnd.choice(["", "", "\n"]) for _ in range(rnd.randrange(200))) for _ in range(40)]
    texts += [" ".join(f"w{i % 4000}" for i in range(20000))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a"), (1, "")], "doc_id long, text string").withColumn("failed", F.lit("x")).withColumn("n_words", F.lit(-1))
    book = quality.ledger(df)
    no_python(book)
    rows = book.collect()
    assert len(rows) == len(texts) + 2 and {r.n_words for r in rows} == {-1}
    for r in rows:
        want = plain_measures(r.text)
        assert r.measure.asDict() == want, r.text
        assert bool(r.failed & 1) == (want["n_words"] < 50)
        assert bool(r.failed & 2) == (100 * want["n_repeat_words"] > 50 * want["n_words"])
    table = {r.rule: r for r in quality.ablation(book, 2).collect()}
    bits = [r.failed & quality.POLICIES[2] for r in rows]
    for rule in quality.RULES:
        bit = 1 << rule.bit
        assert table[rule.name].n_failed == sum(b & bit > 0 for b in bits) and table[rule.name].n_only == sum(b == bit for b in bits)
    assert book.where(quality.verdict(1)).count() == sum(not b & 3 for b in bits)
    assert quality.ledger(df.limit(0)).count() == 0


# chat


def fold(rows):
    return sorted((r.conv_id, [(t.role, t.text) for t in r.turns]) for r in rows)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\/INST]x", "[", "<", "s>", "INST] ", " [/INST]", "<<s>", "a</s", "", "[INST", "\\", "é<s>\n"]
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate(zip(["system", "user", "assistant"] * 5, random.Random(i).sample(hard, len(hard))))]
    rows += [(9, 0, None, None), (9, None, "assistant", "first"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.col("turn"), "kind": F.lit("message"), "piece": F.lit("clash"), "formatted": F.lit(1)})
    out = chat.format_chats(df).withColumns({"turns": chat.read_back(F.col("formatted")), "loss": chat.loss_text("formatted", "loss_spans")})
    no_python(out)
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((r or "", x or ""))
    for r in out.collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert r.formatted.count("</s>") == len(want[r.conv_id])
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_events(spark):
    log = [
        (1, 0, 0, "message", "user", "helo"), (1, 0, 5, "edit", None, "hello"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "c"), (1, 1, 8, "delta", None, "d"), (1, 2, 9, "delta", "user", "late start"), (1, 3, 10, "unknown", "user", "x"),
    ]
    random.Random(1).shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert fold(out) == [(1, [("user", "hello"), ("assistant", "cd"), ("user", "late start")])]


def test_chat_of_long_texts_and_many_deltas(spark):
    long = "word </s>[INST] " * 60_000
    rows = [(1, 0, 0, "message", "user", long), (1, 1, 1, "message", "assistant", "a draft")] + [(1, 1, 2, "regenerate", "assistant", None)]
    rows += [(1, 1, 3 + k, "delta", "assistant", f"{k},") for k in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string")
    began = time.time()
    (r,) = chat.format_chats(df).select(chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text("formatted", "loss_spans").alias("loss")).collect()
    answer = "".join(f"{k}," for k in range(20_000))
    assert [(t.role, t.text) for t in r.turns] == [("user", long), ("assistant", answer)] and r.loss == answer
    assert time.time() - began < 60


# secrets


def plain_spans(text):
    out = []
    for nr, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text or "", re.I | re.A if r.any_case else re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), m.end(), nr, r.kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets_against_plain_scan(spark):
    rnd = random.Random(4)
    parts = ["password=abc", "PassWord: 'abcdef1'", "api_key = \"zz99zz99\"", "apikey:q", "secret=token: abcdef", "token : é", "AKIA" + "A1B2" * 4, "AKIAX", "0123456789abcdef" * 2, "deadbeef", "é", " ", "\n", "x",
             "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghij.abcdefghij.abcdefghij", "ghp_" + "a" * 36, "passwd==", "tokentoken=secret=abcdefgh", "K", "ſecret=abcdefg"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "password=hunter22"), (5, "AKIA" + "Z" * 16), (402, "a" * 30000 + "f0" * 400 + " secret=" + "x" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kind": F.lit("clash"), "secrets": F.lit(0), "doc": F.lit(1), "kinds": F.lit(2)})
    out = secrets.scan(df)
    no_python(out)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.secrets] == plain_spans(r.text), r.text
    assert secrets.scan(df.limit(0)).collect() == []


def test_trigram_queries():
    by = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert by["access"] == [[frozenset({"AKI", "KIA"})]] and by["hex"] == []
    assert frozenset({"tok", "oke", "ken"}) in by["assign"][0] and len(by["assign"][0]) == 6
    assert all(by[k] for k in ("private_key", "web_token", "forge_token"))


def test_secrets_of_a_text_with_very_many(spark):
    """64 000 keys in one text: time grows with their number, not with its square."""
    text = "\n".join(f"{k:032x}" for k in range(64_000))
    began = time.time()
    (row,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.start, s.end, s.kind) for s in row.secrets] == [(33 * k, 33 * k + 32, "hex") for k in range(64_000)]
    assert time.time() - began < 60


# line dedup


def test_line_dedup(spark):
    sites = [f"s{i}" for i in range(12)]
    rows = [(10 + i, f"own {i}\n All rights reserved. \n\nown b{i}", s) for i, s in enumerate(sites)]
    rows += [(50 + i, f"near line\nx{i}", s) for i, s in enumerate(sites[:10])] + [(70 + i, f"rare line\ny{i}", s) for i, s in enumerate(sites[:9])]
    rows += [(100 + i, "one site only\nz", "s0") for i in range(30)] + [(200, None, "s1"), (201, "", "s2"), (202, "All rights reserved.", None), (None, "near line\nkeep", "s11"), (50, "near line\ntwin", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "n_removed": F.lit("x"), "first_doc": F.lit(2)})
    out = line_dedup.remove_boilerplate(df, min_sites=10)
    no_python(out)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r.n_removed))
    assert got[10] == [("own 0\n All rights reserved. \n\nown b0", 0)] and got[11] == [("own 1\n\nown b1", 1)]
    assert sorted(got[50]) == [("near line\ntwin", 0), ("near line\nx0", 0)] and got[59] == [("x9", 1)]
    assert got[None] == [("keep", 1)] and got[202] == [("", 1)]
    assert got[75] == [("rare line\ny5", 0)] and got[120] == [("one site only\nz", 0)]
    assert got[200] == [(None, 0)] and got[201] == [("", 0)]
    assert line_dedup.remove_boilerplate(df.limit(0)).collect() == []


def plain_dedup(rows, min_sites):
    lines = defaultdict(lambda: (set(), set()))
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                sites, ids = lines[x.strip(" \t\n\x0b\x0c\r")]
                sites.add(s)
                ids.add(i)
    out = []
    for i, t, s in rows:
        parts = [] if t is None else t.split("\n")
        bad = lambda x: len(lines[x][0] - {None}) >= min_sites and lines[x][1] - {None} and i != min(lines[x][1] - {None}) if x else False
        stay = [x for x in parts if not bad(x.strip(" \t\n\x0b\x0c\r"))]
        out.append((i, None if t is None else "\n".join(stay), len(parts) - len(stay)))
    return out


def test_line_dedup_against_plain_version(spark):
    rnd = random.Random(6)
    pool = [f" line {k}" for k in range(30)] + ["", " ", "\t"]
    rows = [(rnd.randrange(60), "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(12))), rnd.choice(["a", "b", "c", "d", None])) for _ in range(120)] + [(None, " line 1\nx", "a"), (3, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("doc", "body", "places", "h", "g", "first_doc", "n_removed"):
        df = df.withColumn(c, F.lit(1))
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_boilerplate(df, min_sites=3).collect()]
    assert sorted(got, key=str) == sorted(plain_dedup(rows, 3), key=str)


def test_line_dedup_of_very_long_texts(spark):
    """Time grows with the lines of a text, not with their square."""
    shared = "\n".join(f"shared line {k}" for k in range(20_000))
    rows = [(i, f"own {i}\n{shared}\nend {i}", f"s{i}") for i in range(12)]
    began = time.time()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (f"own {i}\nend {i}", 20_000) for i in range(1, 12))
    assert time.time() - began < 60


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(passes * sizes[s] for s in full)
        level = left / sum(w[s] for s in rest) if rest else 0
        more = {s for s in rest if level * w[s] > passes * sizes[s] + 1e-9}
        if not more:
            return {s: passes * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


def test_mixing(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(30))), rnd.choice(["a", "a", "a", "b", "c", "d", "é", None, ""])) for i in range(3000)]
    rows += [(5000, None, "only null"), (5001, "", "b"), (None, "x y", "c"), (7, "w w w", "a"), (7, "w w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "mix": F.lit(0), "nr": F.lit(1), "source_size": F.lit(2)})
    first, again = mixing.mix(df).collect(), mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.source or "", r.mix["size"], r.mix.taken)
    assert sorted(map(key, first)) == sorted(map(key, again))
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), Counter()
    for r in first:
        assert r.mix.target == pytest.approx(want[r.source]) and r.mix.source_size == sizes[r.source]
        assert r.mix.taken in (0, r.mix["size"], 2 * r.mix["size"])
        taken[r.source] += r.mix.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    drawn = mixing.mixed_documents(df)
    assert drawn.count() == sum(r.mix.taken // r.mix["size"] for r in first if r.mix["size"]) and drawn.columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []


def test_oracles_name_queries():
    from sealmark.llm import queries

    assert set(oracles.SQL) <= set(queries.queries())
    assert hashlib.sha256(b"").hexdigest()


def test_mix_counts_a_very_long_text_whole(spark):
    long = " ".join(["w"] * 300_000)
    rows = [(1, long, "a"), (2, "x y z", "a"), (3, "one two", "b"), (4, "p q r s", "c")]
    got = {r.doc_id: r.mix for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 300_000 and got[2].source_size == 300_003 and all(m.taken in (0, m.size, 2 * m.size) for m in got.values())
    assert sum(m.taken for m in got.values()) <= 1.5 * 300_009


def test_clashing_names(spark):
    """Columns of a table that are called as the operators' own stay, in the operators and over the stages."""
    import corpus_pipeline as cp

    taken = ["mix", "mix_size", "mix_h", "mix_of", "cut", "last_turn", "first_turn", "part_nr", "part", "at", "t", "computed_row", "failed", "measure", "n_removed", "doc", "places", "secret_doc", "secret_kinds", "gone_id", "c0", "c1", "id", "h"]
    rnd = random.Random(1)
    texts = ["\n".join(" ".join(rnd.choice(["some", "more", "words", "about", "things", f"w{k}{j}"]) for j in range(30)) for _ in range(4)) + "\nshared" for k in range(40)]
    rows = [(i, t, "en", f"s{i % 12}", len(t), *(f"{c}{i}" for c in taken)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in taken))

    def kept(df, but=()):
        for r in df.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in taken if c not in but)

    kept(quality.ledger(docs), ("measure", "failed"))
    kept(secrets.scan(docs))
    kept(mixing.mix(docs), ("mix",))
    kept(line_dedup.remove_boilerplate(docs), ("n_removed",))
    now, plain = docs, docs.drop(*taken)
    for _, stage in cp.STAGES[:4]:
        now, plain = stage(spark, now, ""), stage(spark, plain, "")
        assert now.columns == docs.columns and now.count() == plain.count() > 0
        kept(now)
    assert cp.STAGES[4][1](spark, now, "").count() == cp.STAGES[4][1](spark, plain, "").count()


def test_mix_of_a_source_per_document(spark, monkeypatch):
    """As many sources as documents, many of which finish together: the budget ends among equal finish times."""
    rows = [(i, "w " * (1 + i % 3), f"site{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.mix.size, r.mix.target, r.mix.taken) for r in mixing.mix(df).collect()}
    weights = [(3, 1, 2)[i % 3] for i in range(3000)]
    sizes = [1 + i % 3 for i in range(3000)]
    level, open_ = sum(sizes) * 1.5, set(range(3000))
    targets = {}
    while True:
        share = (level - sum(targets.values())) / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] >= 2 * sizes[i]}
        if not full:
            break
        targets |= {i: 2.0 * sizes[i] for i in full}
        open_ -= full
    targets |= {i: share * weights[i] for i in open_}
    assert all(got[i][0] == sizes[i] and abs(got[i][1] - targets[i]) < 1e-9 for i in range(3000))
    taken = sum(v[2] for v in got.values())
    assert sum(targets.values()) - 3 <= taken <= sum(targets.values())


def test_events_of_the_chat_query_leave_the_given_turns(spark):
    from sealmark.llm import queries

    rows = [(i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("user", "hello"), ("assistant", "é"), (None, None), ("assistant", ""), ("user", "</s>[INST]")])] + [(0, 1, "assistant", "é"), (0, 1, "user", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = queries._as_events(turns)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    want = sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    assert sorted((r.conv, r.turn, r.role, r.text) for r in chat.final_messages(log).collect()) == want
