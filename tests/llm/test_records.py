import pytest
from oracle import compare, tables
from pyspark.sql import functions as F

from ledgerloom.llm import copies, incremental, overlap, queries, splits

ROOT = "/root/testdata/sf0.01"
SCHEMA = "id string, source string, source_record_id string, ingest_batch int, transaction_date string, merchant_raw string, merchant_norm string, amount double, direction string, key string, n long, cls string"


def gold(spark, rows):
    base = {"source": "bank", "source_record_id": None, "ingest_batch": 1, "transaction_date": "2024-01-05", "merchant_raw": "Stapevegro Bakery", "merchant_norm": None, "amount": 5.0, "direction": "expense", "key": "clash", "n": 7, "cls": "clash"}
    return spark.createDataFrame([tuple(({"id": r[0]} | base | r[1])[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    got, wanted = compare(spark, tables(ROOT), ROOT, queries.QUERIES[name], queries.ORACLES[name])
    assert got == wanted


COPIES = [
    ("a", {}), ("b", {"merchant_raw": "bakery,STAPEVEGRO!"}), ("c", {"amount": 5.0000001, "direction": " Expense"}), ("d", {"amount": 5.01}), ("e", {"source": "toast"}), ("f", {"amount": None}), ("g", {"amount": None}),
    ("h", {"direction": None}), ("i", {"direction": None}), ("j", {"amount": float("nan")}), ("k", {"merchant_raw": None}), ("l", {"merchant_raw": "--"}), ("m", {"transaction_date": None}), ("o", {"merchant_raw": "x y " * 50000}),
]


def test_copies(spark):
    df = gold(spark, COPIES)
    assert {tuple(r) for r in copies.copy_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("k", "l")}
    sizes = {r.id: r.n_copies for r in copies.collapse(df).collect()}
    assert sizes == {"a": 3, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "i": 1, "j": 1, "k": 2, "m": 1, "o": 1}
    assert copies.copy_pairs(gold(spark, [])).count() == 0 == copies.collapse(gold(spark, [])).count()


SAME = [
    ("01", {"source_record_id": "bnk-1"}), ("02", {"ingest_batch": 2, "source_record_id": " BNK/1 ", "merchant_raw": "Other Name", "amount": 77.0}), ("03", {"ingest_batch": 2, "transaction_date": "2024-01-06", "merchant_raw": "BAKERY STAPEVERGO"}),
    ("04", {"ingest_batch": 3, "transaction_date": "2024-01-07", "merchant_raw": "stapevegro bkry"}), ("05", {"ingest_batch": 3, "transaction_date": "2024-01-09"}), ("06", {"ingest_batch": 3, "merchant_raw": "Zathadotra Fuel Depot"}),
    ("07", {"ingest_batch": 3, "amount": None}), ("08", {"ingest_batch": 4, "amount": None}), ("09", {"ingest_batch": 4, "source": "toast", "source_record_id": "bnk-1", "amount": 1.0}), ("10", {"ingest_batch": None}), ("11", {"ingest_batch": 5, "transaction_date": "soon"}),
    ("12", {"ingest_batch": 5, "merchant_raw": None}), ("13", {"ingest_batch": 6, "source": None, "source_record_id": "bnk-1", "direction": None}),
]


def found(df, folder, at_once=40):
    return {tuple(r) for r in incremental.replay(df, str(folder), at_once).repeats().collect()}


def test_repeats(spark, tmp_path):
    assert found(gold(spark, SAME), tmp_path / "a") == {("01", "02"), ("01", "03"), ("01", "04")}
    assert found(gold(spark, []), tmp_path / "b") == found(gold(spark, [("1", {"merchant_raw": None})]), tmp_path / "c") == set()


def test_history_batch_by_batch(spark, tmp_path):
    df = gold(spark, SAME)
    history = incremental.History(spark, str(tmp_path))
    history.accept(df.where("ingest_batch = 1"))
    (tmp_path / "commits" / "n0").rename(tmp_path / "lost")  # a call that failed before its commit
    assert history.repeats().count() == 0
    history.accept(df.where("ingest_batch = 1"))
    later = df.where("ingest_batch in (2, 3)")
    wanted = {("01", "02"), ("01", "03"), ("01", "04")}
    assert {tuple(r) for r in history.check(later).collect()} == wanted
    history.accept(later)
    history.accept(later)
    assert {tuple(r) for r in history.repeats().collect()} == wanted and history.commits() == ([0, 1], [1, 2, 3])


def test_chains_closed_by_later_batches(spark, tmp_path):
    """However the batches are grouped, the rows are those of the whole table's chains (brute force)."""
    import random

    from ledgerloom.llm.names import core, relation

    rng = random.Random(7)
    names = ["stapevegro bakery", "stapevergo bakery", "stapevegro", "zathadotra fuel depot", "zathadotra fuel", "klechethasham mfg"]
    rows = [(f"{i:03d}", {"ingest_batch": 1 + i // 12, "merchant_raw": rng.choice(names), "transaction_date": f"2024-01-{rng.randrange(1, 29):02d}", "source_record_id": rng.choice([None, None, f"r{rng.randrange(25)}"])}) for i in range(60)]
    root = {r[0]: r[0] for r in rows}
    top = lambda x: x if root[x] == x else top(root[x])
    day = lambda r: int(r[1]["transaction_date"][-2:])
    for i, p in enumerate(rows):
        for q in rows[:i]:
            ref = p[1]["source_record_id"] is not None and p[1]["source_record_id"] == q[1]["source_record_id"]
            if ref or (abs(day(p) - day(q)) <= 1 and relation(core(p[1]["merchant_raw"]), core(q[1]["merchant_raw"]), 2)) or (p[1]["merchant_raw"] == q[1]["merchant_raw"] and abs(day(p) - day(q)) <= 1):
                a, b = sorted((top(p[0]), top(q[0])))
                root[b] = a
    batch = {r[0]: r[1]["ingest_batch"] for r in rows}
    first = {}
    for r in rows:
        first.setdefault(top(r[0]), []).append(r[0])
    wanted = {(min(c), x) for c in first.values() for x in c if batch[x] > min(batch[y] for y in c)}
    assert len(wanted) > 20
    assert found(gold(spark, rows), tmp_path / "one") == wanted == found(gold(spark, rows), tmp_path / "each", 2)


def test_a_slot_of_very_many_names(spark, tmp_path):
    """Names that share direction, amount, day and trade word are not compared pair by pair, and none that is alike is lost."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    base = sorted({word() for _ in range(3000)})
    rows = [(f"a{i:05d}", {"merchant_raw": f"{w} bakery"}) for i, w in enumerate(base)]
    rows += [(f"b{i:05d}", {"ingest_batch": 2, "merchant_raw": f"{w[:3]}{w[4]}{w[3]}{w[5:]} bkry"}) for i, w in enumerate(base[::10])]
    got = {y: x for x, y in found(gold(spark, rows), tmp_path)}
    assert set(got) == {r[0] for r in rows if r[0][0] == "b"}


def test_overlap(spark):
    df = gold(spark, SAME)
    s = spark.createDataFrame([("01", "train"), ("02", "test"), ("03", "validation"), ("04", "train"), ("05", "test"), ("07", "train"), ("08", "test"), ("09", None)], "id string, split string")
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(overlap.same_record_classes(df), s).collect()}
    assert got == {("01", "02"), ("01", "03"), ("02", "04"), ("03", "04")}


def test_segments_join_everything_within_their_reach(spark):
    import random

    rng = random.Random(4)
    codes = [rng.getrandbits(63) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(0, 9))) for c in codes]
    df = spark.createDataFrame([(i, "expense", 5, 5, 5, c) for i, c in enumerate(codes)], "pay long, dir string, cents long, day int, at int, code long")
    reach = overlap.SEGMENTS - 1
    wanted = {(i, j) for i in range(80) for j in range(i + 1, 80) if bin(codes[i] ^ codes[j]).count("1") <= reach}
    got = {tuple(r) for r in overlap.near_pairs(df, df, bound=100).collect()}
    assert wanted <= got and all(bin(codes[i] ^ codes[j]).count("1") <= overlap.RADIUS for i, j in got)


def test_hot_record_is_one_payment(spark, tmp_path):
    """A third of the rows are one record under many references: links stay one a row."""
    rows = [(f"{i:05d}", {"ingest_batch": 1 + i % 3, "source_record_id": f"bnk-{i}"}) for i in range(3000)] + [(f"x{i}", {"amount": float(i)}) for i in range(10, 30)]
    got = incremental.replay(gold(spark, rows), str(tmp_path)).repeats()
    assert got.count() == 2000 and got.select("id_a").distinct().count() == 1


def test_splits(spark):
    rows = [(f"r{i:04d}", {"merchant_norm": [f"shop {i % 150}", f" SHOP {i % 150}"][i % 2]}) for i in range(3000)]
    rows += [(f"h{i:04d}", {"merchant_norm": "hot"}) for i in range(700)] + [(f"n{i:03d}", {"merchant_norm": [None, " "][i % 2], "source": ["bank", None][i // 20]}) for i in range(40)]
    df = gold(spark, rows)
    out, forest = splits.assign(df, splits.entity_keys(F.col("merchant_norm"), F.col("source")))
    out = out.withColumn("entity", F.coalesce(F.nullif(F.lower(F.trim("merchant_norm")), F.lit("")), F.coalesce("source", F.lit("none"))))
    assert out.count() == len(rows) and out.groupBy("entity").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    share = {r["split"]: r["count"] / len(rows) for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02 and abs(share["validation"] - 0.1) < 0.02
    assert forest.count() > 0
    none, _ = splits.assign(gold(spark, []), splits.entity_keys(F.col("merchant_norm"), F.col("source")))
    assert none.count() == 0


def test_later_records_join_the_kept_forest(spark, tmp_path):
    keys = splits.entity_keys(F.col("merchant_norm"), F.col("source"))
    first = gold(spark, [(f"r{i:04d}", {"merchant_norm": f"shop {i % 60}"}) for i in range(600)])
    placed = {r.merchant_norm: r.split for r in splits.assign(first, keys, folder=str(tmp_path))[0].collect()}
    later = gold(spark, [("x1", {"merchant_norm": " SHOP 7"}), ("x2", {"merchant_norm": "shop 8"}), ("x3", {"merchant_norm": "new"}), ("x4", {"merchant_norm": "NEW "})])
    got = {r.id: r for r in splits.attach(later, keys, str(tmp_path)).collect()}
    assert got["x1"].split == placed["shop 7"] and got["x2"].split == placed["shop 8"]
    assert got["x3"].split == got["x4"].split is not None and not any(r.conflict for r in got.values())
    again = {r.id: r.split for r in splits.attach(gold(spark, [("y", {"merchant_norm": "New"})]), keys, str(tmp_path), n=2).collect()}
    assert again["y"] == got["x3"].split
    two = [(F.col("merchant_norm")), F.col("source")]
    split = {placed["shop 1"], placed["shop 2"]}
    pair = gold(spark, [("z1", {"merchant_norm": "n|shop 1", "source": "n|shop 2"})])
    tied = splits.attach(pair, two, str(tmp_path), n=3).collect()[0]
    assert tied.split in split and tied.conflict == (len(split) > 1)
