"""Pairs of names that are alike although their fingerprints or chunks aren't, with no third row to link them."""

from ledgerloom.llm import incremental, overlap
from ledgerloom.llm.names import relation

SCHEMA = "id string, source string, source_record_id string, ingest_batch int, transaction_date string, merchant_raw string, amount double, direction string"
FAR = [("grisikliran fuel depot", "grisikliranfueldepot"), ("plsigaze bakery", "plisigazebakery"), ("geradrose management", "geradrose management training")]


def gold(spark, rows):
    return spark.createDataFrame([(i, "bank", None, batch, day, name, amount, "expense") for i, batch, day, name, amount in rows], SCHEMA)


def split_pairs(spark, names):
    rows = [(f"{i}{side}", 1, "2024-01-05", n, 5.0 + i) for i, two in enumerate(names) for side, n in zip("ab", two)]
    s = spark.createDataFrame([(r[0], "train" if r[0].endswith("a") else "test") for r in rows], "id string, split string")
    return {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(overlap.same_record_classes(gold(spark, rows)), s).collect()}


def test_overlap_of_names_with_far_fingerprints(spark):
    for a, b in FAR:
        assert bin((overlap.fingerprint(a) ^ overlap.fingerprint(b)) & (2**64 - 1)).count("1") > overlap.RADIUS and relation(a, b, edits=2)
    assert split_pairs(spark, [*FAR, ("stapevegro bakery", "zathadotra fuel depot")]) == {(f"{i}a", f"{i}b") for i in range(len(FAR))}


def test_repeats_of_names_without_common_chunks(spark, tmp_path):
    a, b = "garjeramis electric servvices", "grajeramis el"
    assert not set(incremental.chunks_of(a)) & set(incremental.chunks_of(b)) and relation(a, b, edits=2)
    df = gold(spark, [("01", 1, "2024-01-05", a, 5.0), ("02", 2, "2024-01-06", b, 5.0), ("03", 2, "2024-01-06", "zathadotra fuel", 5.0)])
    for at_once in (1,):
        assert {tuple(r) for r in incremental.replay(df, str(tmp_path / str(at_once)), at_once).repeats().collect()} == {("01", "02")}
