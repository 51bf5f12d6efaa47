from claimcheck import queries as Q
from claimcheck.claims import sample_claims
from claimcheck.plans import cube
from claimcheck.sources.dataset import attach
from claimcheck.streaming.reverify import reverify, verify_from_cube
from claimcheck.verify import verify_claims

D = "/root/testdata/sf0.001/orders.parquet"


def _seen(verdicts):
    return [(v.claim_id, v.verdict, v.abstain_reason, v.row_counts, None if v.computed is None else round(v.computed, 6)) for v in verdicts]


def test_cube_answers_as_the_table_does(spark):
    ds = attach(spark.read.parquet(D), Q.CONFIG)
    c = cube.build(ds, Q.CONFIG).cache()
    want = _seen(verify_claims(ds, sample_claims(), Q.CONFIG))
    assert _seen(verify_from_cube(c, sample_claims(), Q.CONFIG)) == want
    halves = [cube.build(attach(ds.df.where(f"o_orderkey % 2 = {k}"), Q.CONFIG), Q.CONFIG) for k in (0, 1)]
    assert _seen(verify_from_cube(halves[0].union(halves[1]), sample_claims(), Q.CONFIG)) == want
    plans = [p for k, p in Q.PLANS.items() if k.startswith(("rank", "share", "growth"))]
    from claimcheck.plans.lowering import execute

    for a, b in zip(cube.execute(c, Q.CONFIG, plans), execute(ds, Q.T, plans, exact=True)):
        assert a.counts == b.counts and [(k, r) for k, _, r in a.ranks] == [(k, r) for k, _, r in b.ranks]
        assert (a.value is None) == (b.value is None) and (a.value is None or abs(a.value - b.value) < 1e-6 * max(1, abs(b.value)))


def test_stream(spark, tmp_path):
    df = spark.read.parquet(D)
    for k in (0, 1):
        df.where(f"o_orderkey % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reverify(stream, sample_claims(), Q.CONFIG, str(tmp_path / "cubes"), lambda n, v: got.__setitem__(n, v), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == 2 and _seen(got[max(got)]) == _seen(verify_claims(attach(df, Q.CONFIG), sample_claims(), Q.CONFIG))
