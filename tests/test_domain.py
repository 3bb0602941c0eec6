"""Operators of the gateway, registry, regions, transactions, quotas, governance and ledger, against plain versions, with dirty and empty input."""

import json
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.client import Client
from tideline.functions import ids
from tideline.operators import govern, lookup, metrics, quota, regions, registry, shred, transactions
from tideline.operators.running import running
from tideline.sources import log
from tideline.sources.ledger import COMMITTED, FAILED, QUARANTINED, STAGED, CommitConflict, Ledger


def test_hashes_and_ids_are_the_published_ones(spark):
    texts = ["", "a", "user-events", "é" * 50, "x" * 1000, None]
    tenant = bytes(range(16))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, p int").withColumn("tenant", F.lit(bytearray(tenant)))
    signed = lambda n: n - (n >> 63 << 64)
    cols = dict(h=ids.xxh64(F.col("t")), g=ids.xxh64(F.col("t"), 0xCAFEBABE), s=ids.topic_stream(F.col("t"), F.col("p")), q=ids.tenant_stream(F.col("tenant"), F.col("t")), b=ids.tenant_stream(F.col("tenant"), F.col("t"), F.col("p")))
    for r in df.select("t", "p", *[c.alias(n) for n, c in cols.items()], ids.shard_of(cols["h"]).alias("shard"), ids.uri_prefix(cols["h"]).alias("prefix")).collect():
        if r.t is None:
            assert r.h is None and r.s is None and r.shard is None
            continue
        raw, at = r.t.encode(), r.t.encode() + r.p.to_bytes(4, "little")
        h = xxhash.xxh64(raw, seed=0).intdigest()
        assert r.h == signed(h) and r.g == signed(xxhash.xxh64(raw, seed=0xCAFEBABE).intdigest())
        assert r.s == b"".join(xxhash.xxh64(at, seed=s).intdigest().to_bytes(8, "little") for s in (0xCAFEBABE, 0xDEADBEEF))
        assert r.q == tenant[:8] + h.to_bytes(8, "little") and r.b == tenant[:8] + xxhash.xxh64(at, seed=0).intdigest().to_bytes(8, "little")
        assert r.shard == (h >> 32) % 1024 and r.prefix == f"{h >> 48:04x}"
    stream = bytes(16)
    uri = df.limit(1).select(ids.chunk_uri("b", F.col("tenant"), F.lit(bytearray(stream)), F.lit(5), F.lit(9))).first()[0]
    assert uri == f"s3://b/chunks/{xxhash.xxh64(tenant + stream + (5).to_bytes(8, 'little'), seed=0).intdigest() >> 48:04x}/{tenant.hex()}/{stream.hex()}/5_9.chk"


def test_tokens_keep_all_their_bits(spark):
    rows = [(s, e, n) for s in (0, 32767, 32768, 40000, 65535) for e in (0, 65535) for n in (0, 2**32 - 1)]
    df = spark.createDataFrame(rows, "s bigint, e bigint, n bigint")
    out = df.select("s", "e", "n", ids.unpack_token(ids.pack_token(F.col("s"), F.col("e"), F.col("n"))).alias("u"), ids.parse_token_bytes(ids.token_bytes(F.col("s"), F.col("e") * 2**40, F.col("n") * 2**20, F.col("n"))).alias("b"))
    for r in out.collect():
        assert tuple(r.u) == (r.s, r.e, r.n) and tuple(r.b) == (r.s, r.e * 2**40, r.n * 2**20, r.n)
    assert spark.range(1).select(ids.parse_token_bytes(F.lit(bytearray(b"short")))).first()[0] is None
    assert [ids_ for ids_ in spark.createDataFrame([(b"ok",), (b"\xff",), (None,)], "b binary").select(ids.strict_text(F.col("b")).alias("t")).collect()] == [("ok",), (None,), (None,)]


def test_checksums(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926
    rows = [("s", i, f"body {i}" if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "stream_id string, log_offset bigint, body string")
    got = {r.start_offset: r.crc32 for r in log.seal(log.chunk_manifest(df, 8, F.length("body")), df, 8, "body").collect()}
    want = {}
    for _, i, b in rows:
        want[i // 8 * 8] = (want.get(i // 8 * 8, 0) + zlib.crc32(f"{i}{b or ''}".encode())) % 2**32
    assert got == want
    tenant, p = bytes([200, *range(15)]), "PROOF-SHRED-200-7-99"
    targets = spark.createDataFrame([(tenant, 7, None, 99, "op", "why")], "tenant_id binary, dek_id bigint, stream_id string, destroyed_at_ns bigint, operator_id string, reason string")
    r = govern.erasure_proofs(targets).first()
    assert r.proof_id == p and r.verification_checksum == zlib.crc32(p.encode() + tenant + (7).to_bytes(8, "little") + (99).to_bytes(8, "little") + b"opwhy")
    assert [x.valid for x in govern.valid_proofs(govern.erasure_proofs(targets).withColumn("operator_id", F.lit("no"))).collect()] == [False]


def test_fetch_by_bytes_cursor_and_segments(spark, tmp_path):
    df = spark.createDataFrame([("s", i, "x" * 10) for i in range(20)] + [("t", 0, "y")], "stream_id string, log_offset bigint, body string")
    page = lambda **k: [(r.log_offset, r.has_more) for r in log.fetch(df, "s", 5, 8, size=F.length("body"), **k).orderBy("log_offset").collect()]
    assert page(max_bytes=35) == [(5, True), (6, True), (7, True)] and page(max_bytes=1) == [(5, True)] and page() == [(i, True) for i in range(5, 13)]
    assert page(max_bytes=1000, end=7) == [(5, False), (6, False), (7, False)]
    c = log.Cursor(df, "s", 3)
    assert [r.log_offset for r in c.poll(4)] == [3, 4, 5, 6] and c.position() == 7
    c.seek(18)
    assert [r.log_offset for r in c.poll(4)] == [18, 19] and c.poll() == [] and c.position() == 20
    for n in ("b", "a"):
        df.where("stream_id = 's'").withColumn("from", F.lit(n)).coalesce(1).write.parquet(f"{tmp_path}/w/{n}")
    segments = log.read_segments(spark, f"{tmp_path}/w")
    out = log.replay(segments, "segment", ["log_offset"]).orderBy("replay_no").collect()
    assert [r.replay_no for r in out] == list(range(40)) and [r.segment for r in out] == sorted(r.segment for r in out)
    assert log.replay(segments.limit(0), "segment", ["log_offset"]).count() == 0


def test_regions(spark):
    b = "region string, at bigint, region_epoch bigint, base_offset bigint, n_records bigint, role_ string"
    events = spark.createDataFrame([("r", 10, "promote", None), ("r", 20, "demote", 7), ("r", 30, "promote", None), ("r", 40, "demote", 2)], "region string, at bigint, kind string, new_epoch bigint")
    rows = [("r", 5, 0, 100, 5, "z"), ("r", 15, 9, 0, 1, "z"), ("r", 25, 6, 0, 1, "z"), ("r", 25, 7, 50, 2, "z"), ("r", 35, 8, 0, 1, "z"), ("r", 45, 2, 9, 1, "z"), ("q", 45, 0, 1, 1, "z")]
    out = regions.apply_batches(spark.createDataFrame(rows, b).drop("role_"), events, 12)
    assert sorted((r.region, r.at, r.region_epoch, r.outcome, r.last_offset) for r in out.collect()) == [
        ("q", 45, 0, "applied", 1), ("r", 5, 0, "applied", 104), ("r", 15, 9, "rejected:primary", None), ("r", 25, 6, "rejected:stale_epoch", None), ("r", 25, 7, "applied", 51), ("r", 35, 8, "rejected:primary", None), ("r", 45, 2, "applied", 9)]
    assert [(r.epoch, r.role) for r in regions.roles_over_time(events).orderBy("at").collect()] == [(1, "primary"), (7, "replica"), (8, "primary"), (2, "replica")]
    assert regions.apply_batches(spark.createDataFrame([], b).drop("role_"), events.limit(0), 12).count() == 0


def test_transactions(spark):
    rec = spark.createDataFrame([("s", i, t) for i, t in enumerate([0, 1, 2, 1, 3, 0, 1])], "stream_id string, log_offset bigint, txn_id bigint")
    marks = spark.createDataFrame([("s", 5, 1, "commit"), ("s", 4, 2, "abort"), ("s", 9, 2, "commit"), ("t", 1, 3, "commit"), ("s", 1, 0, "abort")], "stream_id string, log_offset bigint, txn_id bigint, kind string")
    assert sorted(r.log_offset for r in transactions.read_log(rec, marks).collect()) == [0, 1, 3, 5]
    assert {r.log_offset: r.txn_state for r in transactions.read_log(rec, marks, False).collect()} == {0: "none", 1: "committed", 2: "aborted", 3: "committed", 4: "open", 5: "none", 6: "open"}
    assert transactions.last_stable(rec, marks).first().last_stable_offset == 4
    latest = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "b", None), ("d", 1, "a", False), ("d", 2, None, True)], "k string, at int, v string, gone boolean")
    assert [(r.k, r.v) for r in transactions.latest_values(latest, "k", ["at"], "gone").collect()] == [("k", "b")]
    assert transactions.read_log(rec.limit(0), marks).count() == 0


def test_token_bucket(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40) * 500_000, rng.choice([1, 2, None, 9]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant string, at bigint, cost int, admitted_before int")
    got = {r.admitted_before: (r.admitted, round(r.tokens, 6)) for r in quota.token_bucket(df, ["tenant"], "at", "cost", 5.0, 1.5, ["admitted_before"]).collect()}
    held = {}
    for tenant, at, cost, i in sorted(rows, key=lambda r: (r[1], r[3])):
        tokens, before = held.get(tenant, (5.0, at))
        tokens = min(5.0, tokens + 1.5 * (at - before) / 1e6)
        ok = tokens >= (cost or 0)
        held[tenant] = (tokens - (cost or 0) * ok, at)
        assert got[i] == (ok, round(held[tenant][0], 6))
    assert quota.token_bucket(df.limit(0), ["tenant"], "at", "cost", 5.0, 1.5).count() == 0


def definition(required=(), **fields):
    return json.dumps({"fields": [{"name": k, "type": v} for k, v in fields.items()], "required_fields": list(required)})


def test_fingerprints(spark):
    same = [definition(["b"], a="Int64", b="Utf8"), '{"required_fields":["b"],\n "fields": {"b": "string", "a": " LONG "}}']
    other = [definition([], a="Int64", b="Utf8"), definition(["b"], a="Int32", b="Utf8"), definition(["b"], a="Int64", c="Utf8")]
    df = spark.createDataFrame([(x,) for x in [*same, *other, "{", None]], "d string")
    got = [r.f for r in df.select(registry.fingerprint(F.col("d")).alias("f")).collect()]
    assert got[0] == got[1] and len(set(got[:5])) == 4 and got[5] is got[6] is None


def test_registering(spark):
    rng = random.Random(2)
    pool = [definition(rng.sample("abc", rng.randrange(3)), **{n: rng.choice(["int", "long"]) for n in rng.sample("abc", rng.randrange(1, 4))}) for _ in range(12)] + ["broken", None]
    rows = [(i, rng.choice("stuv"), rng.choice(pool), i // 3) for i in range(200)] + [(999, None, pool[0], 1)]
    levels = {"s": "none", "t": "FORWARD", "u": "Full"}
    df = spark.createDataFrame(rows, "schema_id bigint, subject string, definition string, registered_at int")
    got = {r.schema_id: (r.outcome, r.assigned_version) for r in registry.register(df, spark.createDataFrame(list(levels.items()), "subject string, level string")).collect()}
    held = {}
    for i, s, text, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[3], r[0])):
        try:
            d = json.loads(text)
        except (TypeError, ValueError):
            assert got[i] == ("unreadable", None)
            continue
        new = {f["name"]: (f["type"], f["name"] in d["required_fields"]) for f in d["fields"]}
        old, version = held.get(s, (None, 0))
        if new == old:
            assert got[i] == ("same", version)
            continue
        level = levels.get(s, "BACKWARD").upper()
        back = old is None or (all(old[n][0] == new[n][0] for n in old.keys() & new.keys()) and not any(q and not old.get(n, ("", False))[1] for n, (_, q) in new.items()))
        forth = old is None or all(n in new for n, (_, q) in old.items() if q)
        if (back or level in ("NONE", "FORWARD")) and (forth or level in ("NONE", "BACKWARD")):
            held[s] = (new, version + 1)
            assert got[i] == ("registered", version + 1)
        else:
            assert got[i] == ("incompatible", None)
    assert len(got) == 200 and registry.register(df.limit(0)).count() == 0
    entries = spark.createDataFrame([(1, "s", 1, pool[0]), (2, "t", 4, pool[0]), (3, "t", 5, pool[0]), (4, "t", 6, None)], "schema_id bigint, subject string, version int, definition string")
    assert sorted(tuple(r)[1:] for r in registry.resolve(entries, entries.where("schema_id = 1").select(registry.fingerprint(F.col("definition")).alias("fingerprint"))).collect()) == [("s", 1, 1), ("t", 4, 2)]
    assert registry.usable(entries, entries.where("version = 4")).count() == 3


def test_access_by_equality(spark):
    rng = random.Random(3)
    pick = lambda xs, n: rng.sample(xs, rng.randrange(n))
    rules = [(rng.choice(["allow", "allow", "deny"]), rng.choice([None, 1, 2]), pick(["a", "b", "c"], 3), pick(["read", "write"], 3)) for _ in range(12)]
    reqs = [(i, rng.choice([1, 2, 3]), rng.choice([pick(["a", "b", "c", "super-admin"], 4), None]), rng.choice(["read", "write", None]), rng.choice([1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(reqs, "request_id int, tenant_id bigint, roles array<string>, action string, resource_tenant bigint")
    rl = spark.createDataFrame(rules, "effect string, tenant_scope bigint, required_roles array<string>, actions array<string>")
    got = {r.request_id: r.decision for r in govern.authorize(df, rl).collect()}
    for i, tenant, roles, action, of in reqs:
        fits = {e for e, scope, need, acts in rules if scope in (None, tenant) and (not need or set(need) & set(roles or ())) and action in acts}
        gate = tenant == of or "super-admin" in (roles or ())
        assert got[i] == ("deny:tenant" if not gate else "deny:rule" if "deny" in fits else "allow" if fits else "deny:default"), i
    assert set(r.decision for r in govern.authorize(df, rl.limit(0)).collect()) <= {"deny:tenant", "deny:default"}


def test_keys_holds_and_chains(spark):
    keys = govern.new_keys(spark.createDataFrame([(1, 1), (1, 2)], "tenant_id bigint, dek_id bigint")).collect()
    assert len({bytes(k.dek) for k in keys}) == 2 and all(len(k.dek) == 32 for k in keys)
    refs = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "tenant_id bigint, dek_id bigint")
    gone = refs.where("dek_id = 2")
    assert {r.dek_id: r.active for r in govern.active_keys(refs, gone).collect()} == {1: True, 2: False, 3: True}
    assert [r.dek_id for r in govern.erase_keys(refs.where("tenant_id = 1"), gone).collect()] == [1]
    ev = spark.createDataFrame([("s", 1, "apply"), ("s", 2, "release"), ("t", 5, "apply"), ("t", 4, "release")], "stream string, at int, kind string")
    assert [r.stream for r in govern.active_holds(ev, ["stream"], ["at"]).collect()] == ["t"]
    chain = govern.build_chain(spark.createDataFrame([(None, 1, "x"), (None, 2, None), (3, 1, "é|2:")], "tenant_id int, seq int, action string"), ["seq", "action"])
    assert govern.verify_chain(chain.where("tenant_id = 3"), ["seq", "action"]).where("intact").count() == 1 and chain.count() == 3
    removed = govern.verify_chain(chain.where("tenant_id IS NULL AND seq = 2"), ["seq", "action"]).first()
    assert not removed.intact


def test_ledger_states_checkpoints_triggers_and_quarantine(spark, tmp_path, monkeypatch):
    book = Ledger(spark, f"file://{tmp_path}/t", max_bytes=1000, max_files=5)
    for i in range(23):
        book.append(spark.range(i, i + 2).coalesce(1), commit_id=f"c{i}")
    assert book.read().count() == 46 and book.read(as_of=5).count() == 10 and book.state("c3") == COMMITTED and book.state("none") is None
    assert len(book._names("checkpoint-")) == 2 and book.current().total_records == 46
    opened = []
    monkeypatch.setattr(book, "_snapshot", lambda n, old=book._snapshot: opened.append(n) or old(n))
    book.read()
    assert len(opened) <= 4
    book.append(spark.range(3), commit_id="c3")  # known, so nothing happens
    assert book.current().snapshot_id == 23
    assert book.due(1, 0, 1000) and book.due(1, 0, 0, 5) and not book.due(1, 0, 999, 4)
    # a writer that died between snapshot and ledger entry
    book._mark("c22", STAGED)
    assert book.append(spark.range(9), commit_id="c22").snapshot_id == 23 and book.state("c22") == COMMITTED

    def conflict(*a, **k):
        raise CommitConflict

    monkeypatch.setattr(book, "commit", conflict)
    with pytest.raises(CommitConflict):
        book.append(spark.range(4).coalesce(1), commit_id="lost", retries=1)
    assert book.state("lost") == FAILED and len(book.orphans()) == 1
    book.quarantine("lost")
    assert book.state("lost") == QUARANTINED and book.orphans() == []


def test_commits_scores_and_status(spark):
    c = spark.createDataFrame([("g", 1, 50), ("g", 2, 20), ("h", 1, None)], "g string, seq int, off bigint")
    assert {r.g: r.committed_offset for r in lookup.committed(c, ["g"], "off", ["seq"]).collect()} == {"g": 20, "h": None}
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (1, '{"a": "1"}'), (2, '{"a": 2, "b": null}'), (2, "[]"), (None, None)], "f int, p string")
    got = {r.field: (r.n_seen, r.score) for r in shred.promotion_scores(rows, "p", "f").collect()}
    assert got == {"a": (3, 0.666667), "b": (2, 0.666667)} and shred.promotion_scores(rows.limit(0), "p", "f").count() == 0
    m = spark.createDataFrame([("s", 1, 10, 12), ("s", 2, 20, 15), ("t", 1, 5, 9)], "s string, at int, source_high bigint, own_head bigint")
    w = spark.createDataFrame([("s",), ("s",), ("u",)], "s string")
    assert {r.s: tuple(r)[1:] for r in metrics.migration_status(m, w, ["s"]).collect()} == {"s": (20, 15, 0, 2), "t": (5, 9, 4, 0), "u": (-1, 0, 0, 1)}
    ph = spark.createDataFrame([("s", i, p) for i, p in enumerate(["ConsumerCutover", "Rollback", "BridgeReplicating"])], "s string, at int, phase string")
    assert [tuple(r) for r in metrics.current_phase(ph, ["s"]).collect()] == [("s", "BridgeReplicating")]
    p = spark.createDataFrame([(True, False, True, True), (False, False, True, True), (False, True, None, True), (False, True, True, False), (None, True, True, True)], "draining boolean, storage boolean, state_plane boolean, memory boolean")
    assert [r.status for r in metrics.readiness(p).collect()] == ["Degraded", "Unhealthy", "Unhealthy", "Degraded", "Healthy"]
    assert metrics.diagnostics(spark, "X").count() == 16


def test_client(spark, tmp_path):
    c = Client(spark, f"file://{tmp_path}/c")
    rows = lambda a, b: spark.createDataFrame([("s", i, f"m{i}") for i in range(a, b)], "stream_id string, at int, body string")
    assert c.produce(rows(0, 3), ["at"], "one") == 3 and c.produce(rows(0, 3), ["at"], "one") == 3 and c.produce(rows(3, 5), ["at"]) == 5
    assert [(r.log_offset, r.body) for r in c.consume("s", 2).poll(9)] == [(2, "m2"), (3, "m3"), (4, "m4")]
    leased = c.lease("s", "g", 2, 100)
    assert [o for o, _ in leased] == [0, 1]
    c.ack("s", "g", [leased[0], (1, 999)])
    c.nack("s", "g", [1])
    assert {r.log_offset: r.state for r in c.states("s", "g").collect()} == {0: "ACKED", 1: "READY", 2: "READY", 3: "READY", 4: "READY"}
    assert [o for o, _ in c.lease("s", "g", 9, 100)] == [1, 2, 3, 4] and c.lease("s", "other", 1, 5)[0][0] == 0


@pytest.mark.parametrize("block", [None, "at div 7"])
def test_running_in_blocks(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None, "b"]), at, rng.choice([None, 1, 5, -2])) for at in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    b = None if block is None else F.expr(block)
    for how, before in (("max", False), ("max", True), ("sum", False), ("sum", True)):
        got = {r.at: r.out for r in running(df, ["k"], ["at"], F.col("v"), "out", how, b, before).collect()}
        for k, at, _ in rows:
            seen = [v for kk, a, v in rows if kk == k and (a < at if before else a <= at) and v is not None]
            assert got[at] == ((max if how == "max" else sum)(seen) if seen else None), (how, before, k, at)
    assert running(df.limit(0), ["k"], ["at"], F.col("v"), "out", block=b).count() == 0
