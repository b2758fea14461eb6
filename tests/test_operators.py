"""Hand-made vectors for what the tables don't show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import bits, checksums, names
from cadenza.functions import fixed_point as fx
from cadenza.operators import align, levels, mix
from cadenza.plans import report
from cadenza.sources import access_units, headers, pcm, wave
from cadenza.streaming import files, units


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("value, wrapped, pcm, shifted", [(2**31, -(2**31), 0, 2**30), (-5, -5, -5, -3), (2**23, 2**23, -(2**23), 2**22), (-(2**31) - 1, 2**31 - 1, -1, -(2**30) - 1)])
def test_integers(spark, value, wrapped, pcm, shifted):
    assert [one(spark, f, v=value) for f in (fx.wrap32(F.col("v")), fx.pcm24(F.col("v")), fx.floor_shift(F.col("v"), 1))] == [wrapped, pcm, shifted]


@pytest.mark.parametrize("value, sample, clipped", [(1.0, 2**23 - 1, True), (-1.0, -(2**23), False), (0.5 / 2**23, 1, False), (-0.5 / 2**23, -1, False), (-1.1, -(2**23), True)])
def test_quantize(spark, value, sample, clipped):
    got = fx.quantize24(F.col("v"))
    assert (one(spark, got[0], v=value), one(spark, got[1], v=value)) == (sample, clipped)


def test_interrupted_ramps(spark):
    rows = [("a", 0, 0, 0.0, 1), ("a", 10, 10, 1.0, 2), ("a", 15, 10, 0.0, 3), ("a", 20, 0, 4.0, 4), ("a", 30, 5, 5.0, 5), ("b", 1, 1, 9.0, 6)]
    # c: a ramp without origin, broken off by another, which ends; then two events at one time, by arrival.
    rows += [("c", 0, 10, 1.0, 7), ("c", 5, 10, 2.0, 8), ("c", 20, 4, 3.0, 9), ("c", 22, 0, 9.0, 10), ("c", 22, 2, 1.0, 11), ("c", 23, 0, 0.0, 12)]
    events = spark.createDataFrame(rows, "k string, t int, d int, x double, n int")
    got = {r.n: r.origin for r in align.interrupted_ramps(events, "k", "t", "d", "x", "n").collect()}
    assert got == {1: None, 2: 0.0, 3: 0.5, 4: 0.25, 5: 4.0, 6: None, 7: None, 8: None, 9: 2.0, 10: 2.5, 11: 9.0, 12: 5.0}
    samples = spark.createDataFrame([("c", t) for t in (0, 4, 14, 15, 19, 20, 21, 22, 24)], "k string, t int")
    at = {r.t: r.position for r in align.positions_at(samples, events, "k", "t", "d", "x", "n").collect()}
    assert at == {0: None, 4: None, 14: None, 15: 2.0, 19: 2.0, 20: 2.0, 21: 2.25, 22: 9.0, 24: 0.0}


@pytest.mark.parametrize("samples, text", [(0, "00:00:00"), (48_000 * 3661, "01:01:01"), (48_000 * 360_000 + 1, "100:00:00"), (48_000 * 868 * 3600, "868:00:00")])
def test_timecode(spark, samples, text):
    assert one(spark, fx.timecode(F.col("v")), v=samples) == text


def test_clipping_is_judged_before_rounding(spark):
    sample, clipped = fx.quantize24(F.col("v"))
    assert (one(spark, sample, v=8388607.4 / 2**23), one(spark, clipped, v=8388607.4 / 2**23)) == (2**23 - 1, True)


def test_coordinates_and_checked_functions(spark):
    assert [one(spark, fx.coordinate_x(F.col("v")), v=v) for v in (0, 31, 62, 63)] == [-1, 0, 1, 1]
    assert [one(spark, fx.coordinate_y(F.col("v")), v=v) for v in (0, 31, 63)] == [1, 0, -1]
    assert [one(spark, fx.coordinate_z(F.col("u"), F.col("v")), u=u, v=v) for u, v in ((1, 15), (0, 15), (0, 0))] == [1, -1, 0]
    assert one(spark, fx.checked_add(F.col("v"), F.col("v")), v=2**62) is None and one(spark, fx.checked_multiply(F.col("v"), F.col("v")), v=3) == 9
    assert one(spark, fx.coefficient(F.col("v"), 3), v=2**28) is None and one(spark, fx.coefficient(F.col("v"), 3), v=-(2**28)) == -(2**31)
    assert one(spark, fx.checked_db_gain(F.col("v")), v=20.0) == pytest.approx(10)
    with pytest.raises(Exception, match="outside the range"):
        one(spark, fx.checked_db_gain(F.col("v")), v=25.0)


@pytest.mark.parametrize("a, b, c", [(3, 4, 5), (-2001, 4_611_686_018_427_000, 9_200_000_000_000_000_000), (2001, 4_611_686_018_427_000, 9_200_000_000_000_000_000), (-(2**63), -(2**63), -(2**63)), (2**62, 2, -1), (2**62, 2, 0), (-(2**62), 2, 0), (-(2**62), 2, -1)])
def test_the_sum_counts_and_not_the_product_before_it(spark, a, b, c):
    a_, b_, c_ = F.col("a"), F.col("b"), F.col("c")
    got = one(spark, F.array(fx.checked_multiply_add(a_, b_, c_), fx.checked_multiply(a_, b_), fx.checked_add(b_, c_)), a=a, b=b, c=c)
    assert got == [x if -(2**63) <= x < 2**63 else None for x in (a * b + c, a * b, b + c)]


def test_order_gate_and_agreement_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 7), (1, 4, 8), (2, 1, None), (2, 2, None)], "k int, n int, e int")
    assert {(r.k, r.n): r.rising for r in levels.order_gate(df, "k", ["n"], "e").collect()} == {(1, 1): True, (1, 2): None, (1, 3): None, (1, 4): True, (2, 1): True, (2, 2): None}
    assert {r.k: r.agree for r in levels.agreement(df, "k", ["e"]).collect()} == {1: False, 2: True}


def test_reconstruction_undoes_a_recursive_filter(spark):
    rng, fir, iir, shift, bits = np.random.default_rng(4), [700, -200], [90, 30], 10, 2
    want = {k: (rng.integers(-5000, 5000, 60) * 4).tolist() for k in (1, 2)}
    rows = []
    for k, values in want.items():
        for n, x in enumerate(values):
            own = [values[n - j] if n >= j else 0 for j in (1, 2)]
            p = (sum(a * b for a, b in zip(fir, own)) + sum(a * b for a, b in zip(iir, ([rest[-1], rest[-2]] if n > 1 else [rest[-1], 0] if n else [0, 0]) if n else [0, 0]))) >> shift
            rest = (rest if n else []) + [x - p]
            rows.append((k, n, x - (p & ~3)))
    got = levels.reconstruct(spark.createDataFrame(rows, "k int, n int, r bigint"), "k", ["n"], "r", fir, iir, shift, bits).collect()
    assert {(r.k, r.n): r.restored for r in got} == {(k, n): x for k, v in want.items() for n, x in enumerate(v)}


def test_thinned_checkpoints(spark):
    df = spark.createDataFrame([(1, p) for p in range(0, 1000)] + [(2, p) for p in range(0, 50)], "k int, p int")
    got = {}
    for r in align.thinned_checkpoints(df, "k", "p", 10, 8).collect():
        got.setdefault(r.k, []).append((r.checkpoint, r.stride))
    assert sorted(got[1]) == [(p, 160) for p in range(0, 1000, 160)] and sorted(got[2]) == [(p, 10) for p in range(0, 50, 10)]


def test_asof_takes_an_update_at_the_sample(spark):
    samples = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "k int, t int")
    updates = spark.createDataFrame([(1, 5, "x"), (1, 6, "y")], "k int, t int, v string")
    assert sorted(tuple(r) for r in align.asof(samples, updates, "k", "t", "v").collect()) == sorted([(1, 5, "x"), (1, 7, "y"), (2, 5, None)], key=str)


def test_levels_of_an_empty_table(spark):
    assert levels.block_levels(spark.createDataFrame([], "k int, t int, v double"), "k", ["t"], "v").collect() == []


def test_folds_reach_only_the_target():
    for source in mix.LAYOUTS:
        for target in mix.LAYOUTS:
            assert all(0 <= j < len(mix.LAYOUTS[target]) for _, j, _ in mix.fold_table(source, target))
    assert mix.fold_table("2.0", "2.0") == [(0, 0, 1.0), (1, 1, 1.0)]
    k = mix.HALF_POWER
    table = lambda a, b: {(mix.LAYOUTS[a][i], mix.LAYOUTS[b][j]): g for i, j, g in mix.fold_table(a, b)}
    assert {x: g for x, g in table("7.1.4", "5.1").items() if x[0] in ("BL", "TBR", "TFL")} == {("BL", "SL"): k, ("TBR", "SR"): k, ("TFL", "FL"): k}
    assert {x: g for x, g in table("5.1.4", "2.0").items() if x[0] in ("TBL", "SR", "FC")} == {("TBL", "FL"): k, ("SR", "FR"): k, ("FC", "FL"): k, ("FC", "FR"): k}
    assert table("5.1.4", "5.1.2")["TBL", "TML"] == 1 and {g for x, g in table("7.1.2", "7.1.4").items() if x[0] == "TML"} == {k} and table("9.1.6", "7.1")["FWR", "FR"] == k


@pytest.mark.parametrize("layout", list(mix.LAYOUTS))
def test_impulses_keep_their_energy(spark, layout):
    rng = np.random.default_rng(1)
    places = [(x, y, z) for x in (-1.0, 0.0, 1.0) for y in (-1.0, 0.0, 0.5, 1.0) for z in (-1.0, 0.0, 1.0)] + rng.uniform(-1, 1, (20, 3)).tolist()
    rows = [(i, 1.0, float(x), float(y), float(z), False) for i, (x, y, z) in enumerate(places)] + [(-1, 1.0, None, None, None, True), (-2, 1.0, None, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "i int, value double, x double, y double, z double, is_lfe boolean")
    out, speakers = mix.render(df, ["i"], layout).collect(), mix.LAYOUTS[layout]
    energy = {}
    for r in out:
        energy[r.i] = energy.get(r.i, 0) + r.value**2
        assert speakers[r.slot] != "LFE" or r.value == (r.i == -1)
    assert all(energy[i] == pytest.approx(1) for i in range(len(places)))
    assert energy[-1] == ("LFE" in speakers) and energy[-2] == 0 and not any(r.available for r in out if r.i == -2)
    assert mix.is_layout(speakers[::-1]) and not mix.is_layout([*speakers, speakers[0]]) and sorted(mix.display_order(speakers)) == sorted(speakers)


def test_anchors_take_an_element_whole(spark):
    rows = [(s, 1.0, float(x), float(y), float(z), False) for s, (x, y, z) in mix.PLACES.items()]
    df = spark.createDataFrame(rows, "s string, value double, x double, y double, z double, is_lfe boolean")
    assert {(r.s, mix.LAYOUTS["9.1.6"][r.slot]) for r in mix.render(df, ["s"], "9.1.6").collect() if r.value > 1e-9} == {(s, s) for s in mix.PLACES}


def test_masks_back_to_speakers(spark):
    got = spark.createDataFrame([(0x63F,), (0x3,), (0x40,), (0,)], "m bigint").select("m", mix.mask_speakers(F.col("m")).alias("s")).collect()
    assert {r.m: r.s for r in got} == {0x63F: list(mix.LAYOUTS["7.1"]), 3: ["FL", "FR"], 0x40: None, 0: []}
    pairs = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a", "a"], ["a", "a"]), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(mix.is_permutation(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_remainders_against_long_division():
    rng = np.random.default_rng(0)
    messages = [bytes(rng.integers(0, 256, int(n)).tolist()) for n in (0, 1, 2, 3, 7, 100, 8190)]
    for polynomial, width in ((0x63, 8), (0x2D, 16), (0x1D, 8)):
        assert checksums.remainders(messages, polynomial, width).tolist() == [checksums.bit_remainder(m, 0, 8 * len(m), polynomial, width) for m in messages]
    assert checksums.bit_remainder(b"\xc1", 2, 6, 0x1D, 8) == 1


def test_keyed_hash(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        df = spark.createDataFrame([(bytearray(b"abc"), hmac.new(key, b"abc", hashlib.sha256).hexdigest()), (bytearray(b""), "x")], "d binary, e string")
        assert [r[0] for r in df.select(checksums.keyed_verdict(F.col("d"), F.col("e"), key)).collect()] == ["ok", "mismatch"]
        assert df.select(checksums.keyed_verdict(F.col("d"), F.col("e"), None).alias("v")).first().v == "not evaluated"


def unit(n):
    return (n // 2).to_bytes(2, "big") + bytes(n - 2)


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, *fields):
        for value, bits in fields:
            self.text += f"{value:0{bits}b}"
        return self

    def bytes(self):
        return int(self.text.ljust(-(-len(self.text) // 8) * 8, "0"), 2).to_bytes(-(-len(self.text) // 8), "big")


def restart_header(elements=0, levels=(31, 30, 29, 28)):
    four = bool(elements)
    b = Bits().put((0xF8726FBA, 32), (0, 8), (0, 2), (1, 2), (0x0F, 5), (0, 2), (0x4F, 13), (0xB752, 16), (0x1000 if four else 0, 16), (7, 32), (4 if four else 3, 4), (0, 2), (3 if four else 0, 2), (0xFC if four else 0x3C, 8))
    b.put((0, 17), (levels[0], 6), (0, 6), (levels[1], 5), (0, 11), (levels[2], 5), (0, 12), (0, 1), (int(four), 1))
    if four:
        b.put((1, 4), (levels[3], 5), (0, 6), (elements - 1, 5), (1, 1), (1, 1), (0, 10))
    data = b.bytes()
    return data + int(checksums.remainders([data], 0x2D, 16)[0]).to_bytes(2, "big")


def make_unit(header, ends, drc=None):
    """A unit whose header parity is right; bodies are zeros."""
    words = b""
    for k, end in enumerate(ends):
        extra = drc is not None and k == 0
        words += ((0x8000 if extra else 0) | 0x2000 | (0 if header else 0x4000) | end // 2).to_bytes(2, "big") + (((drc & 0x1FF) << 7).to_bytes(2, "big") if extra else b"")
    size = 4 + len(header) + len(words) + ends[-1]
    first = bytearray((size // 2).to_bytes(2, "big") + b"\0\0")
    parity = 0
    for b in bytes(first) + words:
        parity ^= b
    want = (parity >> 4) ^ (parity & 15) ^ 15
    first[2] ^= want
    return bytes(first) + header + words + bytes(ends[-1])


def test_headers_and_directories(spark):
    head = restart_header(16)
    assert len(head) == 32 and headers.parse_header(bytes(4) + head) == {"status": "ok", "header_bytes": 32, "layers": 4, "elements": 16, "dialogue": [31, 30, 29, 28]}
    assert headers.parse_header(bytes(4) + restart_header())["layers"] == 3
    for k in range(8 * len(head)):
        damaged = bytearray(head)
        damaged[k // 8] ^= 128 >> k % 8
        assert headers.parse_header(bytes(4) + bytes(damaged))["status"] != "ok"
    assert headers.parse_header(bytes(4) + head[:20])["status"] == "corrupt"
    units = [make_unit(head, [4, 10, 12, 20], drc=-3), make_unit(b"", [2, 4, 6, 8]), make_unit(b"", [2, 4, 6, 8], drc=5)]
    bad = bytearray(units[1])
    bad[2] ^= 1
    df = spark.createDataFrame([("a", 0, bytearray(units[1])), ("a", 1, bytearray(units[0])), ("a", 2, bytearray(units[1])), ("a", 3, bad), ("a", 4, bytearray(units[2]))], "s string, n int, payload binary")
    rows = headers.directories(headers.headers(df, "s", "n"))
    got = {r.n: (r.restart, r.interval_id, r.directory.status) for r in rows.collect()}
    assert got == {0: (False, 0, "need restart"), 1: (True, 1, "ok"), 2: (False, 1, "ok"), 3: (False, 1, "corrupt"), 4: (False, 1, "ok")}
    assert {(r.n, r.layer): (r.begin, r.end, r.drc) for r in headers.layers(rows, "s", "n").collect() if r.layer < 2} == {(1, 0): (0, 4, -3), (1, 1): (4, 10, None), (2, 0): (0, 2, -3), (2, 1): (2, 4, None), (4, 0): (0, 2, 5), (4, 1): (2, 4, None)}
    assert [r[0] for r in df.select(headers.size_status(F.col("payload"))).collect()] == ["ok"] * 5
    with pytest.raises(Exception, match="need restart"):
        headers.directories(headers.headers(df, "s", "n"), strict=True).collect()


def test_position_events():
    def event(elements, ramp):
        body = Bits().put((0, 1), (1, 2), (2, 2), (0, 3), (3, 6), *ramp, (1, 1))
        for k in range(elements):
            body.put((0, 1), (0, 2), (1, 1))
            if k:
                body.put((k, 6), (63, 6), (k % 2, 1), (15, 4), (0b000010000, 9))
            body.put((0, 1))
        size = -(-len(body.text) // 8)
        head = Bits().put((0, 2), (elements - 1, 5), (0b110, 3), (0x11, 8))
        groups, v = [], size - 1
        while True:
            groups.append(v & 15)
            if v < 16:
                break
            v = (v >> 4) - 1
        for k, g in enumerate(reversed(groups)):
            head.put((g, 4), (int(k < len(groups) - 1), 1))
        head.text += body.text.ljust(8 * size, "0")
        return head.bytes()

    got = headers.parse_event(event(12, [(3, 2), (1, 1), (6, 4)]), 12)
    assert (got["status"], got["sample_offset"], got["ramp"], len(got["targets"])) == ("ok", 18 + 96, 1000, 12)
    assert got["targets"][0] == {"x": 0.0, "y": 1.0, "z": -1.0} and got["targets"][5] == {"x": 5 / 31 - 1, "y": -1.0, "z": 1.0}
    assert headers.parse_event(event(12, [(2, 2)]), 12)["ramp"] == 1536 and headers.parse_event(event(12, [(2, 2)]), 14)["status"] == "corrupt"
    assert headers.parse_event(event(12, [(2, 2)])[:9], 12)["status"] == "corrupt"


def test_bit_cursor():
    c = bits.BitCursor(b"\xf1\x80")
    assert (c.read(3), c.signed(2), c.read(2), c.at) == (7, -2, 0, 7)
    with pytest.raises(bits.StreamError):
        c.align(8)
    with pytest.raises(bits.StreamError):
        bits.BitCursor(b"\xff" * 8).variable(4)


FRAGMENTS = [1, 3, 7, 5, 65_536]


@pytest.mark.parametrize("tail, status", [(b"", None), (b"\x00\x09ab", "truncated"), (b"\x00\x01ab", "corrupt")])
def test_streamed_units_are_those_of_a_batch(spark, tmp_path, tail, status):
    data = b"".join(unit(n) for n in (4, 10, 4, 300, 8190, 6)) + tail
    rows = [(f"s{size}", k, bytearray(data[a : a + size]), a + size >= len(data)) for size in FRAGMENTS[1:] for k, a in enumerate(range(0, len(data), size))]
    schema = "stream_id string, fragment bigint, data binary, final boolean"
    df = spark.createDataFrame(rows, schema)
    want = sorted((name, *r[1:4], r[5]) for name in {r[0] for r in rows} for r in access_units.frame(data, name))
    assert status is None or {r[-1] for r in want} == {"ok", status}
    same = lambda out: sorted((r.stream_id, r.au, r.byte_offset, r.n_bytes, r.status) for r in out)
    assert same(units.batch_units(df).collect()) == want
    if status == "truncated":
        # Fragments out of order, a repeated one, in three micro-batches.
        ordered = df.where("stream_id != 's3'").toPandas()
        for k, part in enumerate([ordered[ordered.fragment < 200], ordered[(ordered.fragment >= 100) & (ordered.fragment < 900)], ordered[ordered.fragment >= 900]]):
            spark.createDataFrame(part.sample(frac=1, random_state=k), schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            query = units.stream_units(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
        assert same(spark.read.parquet(f"{tmp_path}/out").collect()) == [r for r in want if r[0] != "s3"]


def test_a_failed_fragment_leaves_the_state():
    state, out = units.feed("s", units.FRESH, [(0, unit(6) + b"\0", False)])
    assert len(out) == 1 and state == (1, b"\0", 1, 6, False)
    with pytest.raises(ValueError, match="truncated"):
        units.feed("s", state, [(1, b"\x05", True)], strict=True)
    assert units.feed("s", state, [(3, b"", False)])[1][-1][-1] == "gap"
    assert units.feed("s", units.feed("s", state, [(1, unit(6)[1:], True)])[0], [(2, b"more", False)])[1] == []


def test_pcm_files(spark, tmp_path):
    rows = [("a.wav", 2, [5, 6]), ("a.wav", 0, [0, -1, 2**23 - 1, -(2**23)]), ("a.wav", 9, None), ("b.wav", 0, [7, 8])]
    df = spark.createDataFrame(rows, "file string, first_sample int, samples array<int>")
    out = f"file://{tmp_path}/o"
    assert sorted(tuple(r)[:2] for r in pcm.write_pcm(df, out, "2.0", mask=3).collect()) == [("a.wav", 3), ("b.wav", 1)]
    rate, mask, got = wave.read((tmp_path / "o/a.wav").read_bytes())
    assert (rate, mask, got.tolist()) == (48_000, 3, [[0, -1], [2**23 - 1, -(2**23)], [5, 6]])
    assert '"speaker": "FR"' in (tmp_path / "o/a.wav.channels.json").read_text()
    with pytest.raises(Exception, match="FileExistsError"):
        pcm.write_pcm(df, out, "2.0")
    assert wave.read((tmp_path / "o/a.wav").read_bytes())[2].tolist() == got.tolist() and not list((tmp_path / "o").glob(".a*"))
    for name, data in (("s32le", np.array([7 << 8, 8 << 8], "<i4").tobytes()), ("f32le", np.array([7 / 2**23, 8 / 2**23], "<f4").tobytes())):
        pcm.write_pcm(df.where("file = 'b.wav'"), f"{out}-{name}", "2.0", file_format=name)
        assert (tmp_path / f"o-{name}/b.wav").read_bytes() == data
    assert pcm.write_pcm(df.limit(0), f"{out}-e", "2.0").collect() == []
    big = pcm.header(8, 0, 2**31)
    assert big[:4] == b"RF64" and int.from_bytes(big[4:8], "little") == 2**32 - 1 and big[12:16] == b"ds64" and int.from_bytes(big[28:36], "little") == 2**31 * 24 and int.from_bytes(big[36:44], "little") == 2**31
    assert pcm.header(2, 0, 5)[:4] == b"RIFF" and len(pcm.header(2, 0, 5)) == len(big) == 104


def test_framing():
    data = unit(4) + unit(10)
    assert [r[1:4] + r[5:] for r in access_units.frame(data + b"\x00\x09ab", "s")] == [(0, 0, 4, "ok"), (1, 4, 10, "ok"), (2, 14, 4, "truncated")]
    assert [r[5] for r in access_units.frame(b"\x00\x01ab", "s")] == ["corrupt"]
    assert list(access_units.frame(b"", "s")) == []


def test_access_unit_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(unit(6) * 3)
    access_units.register(spark)
    rows = spark.read.format("access_units").option("paths", f"file://{tmp_path}/a.bin").load().collect()
    assert [(r.au, r.byte_offset, r.n_bytes, r.status) for r in rows] == [(0, 0, 6, "ok"), (1, 6, 6, "ok"), (2, 12, 6, "ok")]
    again = spark.read.format("access_units").option("paths", f"file://{tmp_path}/a.bin").option("start", "6").option("au", "1").load().collect()
    assert again == rows[1:]
    import io

    for data in (unit(4) + unit(10) + b"\x00\x09ab", b"\x00\x01ab", b"", unit(4) + b"\x00"):
        assert list(access_units.frame_stream(io.BytesIO(data), "s")) == list(access_units.frame(data, "s"))


def test_wave_round_trip():
    samples = np.array([[0, -1], [2**23 - 1, -(2**23)], [5, 6]])
    rate, mask, got = wave.read(wave.header(2, 3, 3) + wave.pack24(samples))
    assert (rate, mask) == (48_000, 3) and (got == samples).all()


def test_names_of_codes(spark):
    df = spark.createDataFrame([(-1,), (0,), (12,), (13,), (None,)], "c int")
    assert [r[0] for r in df.select(names.status_name(F.col("c"))).collect()] == ["unknown status", "ok", "cancelled", "unknown status", None]
    assert [r[0] for r in df.select(names.backend_name(F.col("c"))).collect()] == ["unknown", "unavailable", "unknown", "unknown", None]
    assert [r[0] for r in df.select(mix.speaker_name(F.col("c"))).collect()] == ["unknown", "FL", "TML", "TMR", None]


def test_events_that_wait(spark):
    # Announced at 0, 0, 5, 5, 40, 41: the second is due at once, the third at 40, the fourth never later than it is told.
    rows = [("a", 0, 100, 0), ("a", 0, 0, 1), ("a", 5, 40, 2), ("a", 5, None, 3), ("a", 40, 41, 4), ("a", 41, 1, 5), ("b", 7, 9, 0)]
    df = spark.createDataFrame(rows, "k string, at long, sample long, n long")
    got = {(r.k, r.n): (r.waiting, r.fits) for r in align.pending_events(df, "k", "at", "sample", "n", 2).collect()}
    assert got == {("a", 0): (0, True), ("a", 1): (1, True), ("a", 2): (1, True), ("a", 3): (2, False), ("a", 4): (2, False), ("a", 5): (2, False), ("b", 0): (0, True)}
    assert align.pending_events(df.limit(0), "k", "at", "sample", "n").collect() == []


@pytest.mark.parametrize("tail, want", [("", ("ok", False, 0)), ("D234D234", ("ok", True, 0)), ("D234E027", ("ok", True, 39)), ("D234E028", ("corrupt", False, None)), ("D235D234", ("corrupt", False, None)), ("D234", ("corrupt", False, None)), ("D234D2340000", ("corrupt", False, None))])
def test_ends_of_layers(spark, tail, want):
    row = spark.createDataFrame([(bytearray.fromhex(tail),)], "t binary").select(headers.end_of_layer(F.col("t")).alias("e"), headers.trimmed(F.sequence(F.lit(1), F.lit(40)), F.lit(want[2])).alias("s")).first()
    assert tuple(row.e) == want and row.s == list(range(1, 41 - (want[2] or 0)))
    assert spark.createDataFrame([(None,)], "t binary").select(headers.end_of_layer(F.col("t")).alias("e")).first().e is None


def wrapped(event, check=0x5A, padding=3):
    body = Bits().put((0, 2), (0, 3), (11, 5), (0, 3), (1, 1), (8, 8), (0, 1), (1, 1), (0, 2), (0, 5), (0, 2), (len(event), 8), (0, 1))
    body.put(*((b, 8) for b in event)).put((0, 5), (1, 2), (0, 2), (check, 8))
    body = body.bytes()
    padding += (len(body) + padding + 1) % 2
    data = bytearray(len(body).to_bytes(2, "big") + body + bytes(padding))
    parity = 0xA9
    for b in data:
        parity ^= b
    data.append(parity)
    word = len(data) // 2
    nibbles = (word >> 8) ^ (word >> 4 & 15) ^ (word & 15)
    return ((nibbles ^ 15) << 12 | word).to_bytes(2, "big") + bytes(data)


def test_wrappers(spark):
    data = wrapped(b"event bytes")
    assert headers.parse_wrapper(data) == {"status": "ok", "event": b"event bytes", "check": 0x5A}
    for k in range(8 * len(data)):
        damaged = bytearray(data)
        damaged[k // 8] ^= 128 >> k % 8
        assert headers.parse_wrapper(bytes(damaged))["status"] == "corrupt"
    assert headers.parse_wrapper(data[:4])["status"] == "corrupt"
    plain = make_unit(restart_header(16), [4, 10, 12, 20])
    # The wrapper lengthens its unit, so the unit's own word and parity change.
    word = (len(plain) + len(data)) // 2
    first = bytearray(word.to_bytes(2, "big") + b"\0\0")
    parity = first[0] ^ first[1]
    for b in plain[36:44]:
        parity ^= b
    first[2] = (parity >> 4) ^ (parity & 15) ^ 15
    df = spark.createDataFrame([("a", 0, bytearray(plain)), ("a", 1, first + plain[4:] + data), ("a", 2, bytearray(b"\0\0"))], "s string, n int, payload binary")
    got = {r.n: r.wrapper for r in headers.wrappers(headers.directories(headers.headers(df, "s", "n"))).collect()}
    assert got[0] is None and got[2] is None and (got[1].status, bytes(got[1].event), got[1].check) == ("ok", b"event bytes", 0x5A)


def test_files_as_streams(spark, tmp_path):
    data = unit(4) + unit(300) + unit(10)
    (tmp_path / "a.bin").write_bytes(data[:200])
    (tmp_path / "b.bin").write_bytes(b"")
    paths = [f"file://{tmp_path}/{x}.bin" for x in "ab"]
    files.register(spark)

    def run(complete):
        source = spark.readStream.format("byte_fragments").option("paths", ",".join(paths)).option("bytes", "64").option("complete", complete).load()
        query = units.stream_units(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.stream_id, r.au, r.byte_offset, r.n_bytes, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("false") == [(paths[0], 0, 0, 4, "ok")]
    (tmp_path / "a.bin").write_bytes(data)
    assert run("true") == [(paths[0], *r[1:4], r[5]) for r in access_units.frame(data, "a")]


def test_report_options(spark):
    for bad in ({}, {"layer": 1, "layout": "5.1"}, {"layer": 4}, {"layer": 1, "gain_db": 1.0}, {"layer": 0, "solo": "FL"}, {"layout": "6.1"}, {"layout": "2.0", "order": ("FL",)}, {"layout": "2.0", "order": ("FL", "FL")}, {"layout": "2.0", "solo": "FC"}, {"layout": "2.0", "gain_db": 25.0}, {"layout": "2.0", "gain_db": float("nan")}, {"layout": "2.0", "start": -1}):
        with pytest.raises(ValueError):
            report.Options(**bad)
    rows = [(0, s, slot, v) for s, slot, v in ((0, 0, 0.5), (1, 0, -0.5), (2, 0, 2.0), (0, 1, None), (1, 1, 0.25))]
    df = spark.createDataFrame([*rows, (1, 0, 0, 1.0)], "layer int, sample long, slot int, value double")
    got = lambda **k: {r.slot: (r.n, r.peak, r.clips) for r in report.report(df, report.Options(**k)).collect()}
    assert got(layer=0) == {0: (3, 2**23 - 1, 1), 1: (1, 2**21, 0)} and got(layer=1) == {0: (1, 2**23 - 1, 1)}
    assert got(layout="2.0", order=("FR", "FL"), limit=2, start=1) == {1: (2, 2**23 - 1, 1), 0: (1, 2**21, 0)}
    assert got(layout="2.0", solo="FR") == {1: (1, 2**21, 0)} and report.report(df.limit(0), report.Options(layer=0)).collect() == []
