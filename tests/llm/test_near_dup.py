import random
import re

from pyspark.sql import functions as F

from sealmark.llm.near_dup import near_duplicates


def brute(rows, width=5, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn("a", F.lit(1))
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def test_against_all_pairs(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 11, 40, 150, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 4, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n := n + 1, rnd.choice([" ", "\n", "\t "]).join(copy).upper() if rnd.random() < 0.2 else " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "Solo"), (1004, "solo"), (1005, "a b c d"), (1006, "A b\tc d")]
    rnd.shuffle(rows)
    # upper-casing é is not ASCII, so those copies differ; brute() sees the same texts
    assert run(spark, rows) == brute(rows)


def test_star_centre_that_is_linked_with_nothing(spark):
    words = [f"t{i}" for i in range(100)]
    # 1 is too far from 2 and 3, which are linked with each other: the centre of their buckets misses the link
    far = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:90] + ["z"] + words[91:]
    rows = [(1, " ".join(far)), (2, " ".join(words)), (3, " ".join([*words[:99], "q"])), (4, " ".join([*words[1:], "p"]))]
    assert run(spark, rows) == brute(rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "one other text of six words"), (7, "one other text of six words"), (None, None)], "doc_id long, text string")
    got = sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 26, None, True), (5, 26, 5, True), (5, 26, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_repeated_id_whose_texts_differ(spark):
    """Each text of an id has a near copy: all are one component, the smallest id is that of the far copy."""
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, " ".join([*one[:59], "x"])), (8, " ".join([*two[:59], "y"])), (5, ""), (3, " ".join([*two[:58], "z", "z"])), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == sorted([(5, 56, 3, False), (5, 56, 3, False), (7, 56, 3, False), (8, 56, 3, False), (5, 0, 3, False), (3, 56, 3, True), (9, 0, 9, True)])


def test_bucket_that_is_split(spark, monkeypatch):
    """A template that many documents share more or less: no link is lost when its buckets are cut."""
    monkeypatch.setattr("sealmark.llm.near_dup.SALT_MEMBERS", 3)
    rnd = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for n in range(40):
        own = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            own[rnd.randrange(120)] = f"n{n}"
        rows.append((n, " ".join(own)))
    assert run(spark, rows) == brute(rows)


def test_very_long_text(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    assert run(spark, rows) == brute(rows)
