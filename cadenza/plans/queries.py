"""The library's operators as queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import checksums
from cadenza.functions import fixed_point as fx
from cadenza.functions import names as labels
from cadenza.operators import align, levels, mix
from cadenza.plans import report
from cadenza.sources import headers

EVENT_ORDER = ["ts", "event_id"]
FOLD = mix.fold_table("5.1.4", "2.0")


#: Microseconds of an event's time, whatever the session's time zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


#: A total order of an order's lines (line numbers may repeat).
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
_LINES = ", ".join(LINE_ORDER)


def block_levels(spark, d):
    """A1, A2: peak, RMS and over-range values of each 40 events of a user."""
    return levels.block_levels(_events(spark, d), "user_id", EVENT_ORDER, "value", 40, 50.0).select("user_id", "block", "n", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), "over")


def sample_clock(spark, d):
    """Samples before each unit."""
    df = levels.clock(_lines(spark, d).withColumn("samples", F.col("l_quantity").cast("bigint")), "l_orderkey", LINE_ORDER, "samples")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "samples", "first_sample")


def asof_hold(spark, d):
    """The latest purchase value at or before each click."""
    e = _events(spark, d)
    at = e.select("user_id", F.expr(MICROS).alias("t"), "event_id", "event_type", "value")
    updates = at.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("held"))
    samples = at.where("event_type = 'click'").select("user_id", "t", "event_id")
    return align.asof(samples, updates, "user_id", "t", "held").select("user_id", "event_id", "t", "held")


def inherit_fill(spark, d):
    """A code holds until the next one."""
    code = F.when(F.col("event_type") == "error", F.col("value"))
    return align.hold(_events(spark, d), "user_id", EVENT_ORDER, code, "code").select("user_id", "event_id", "code")


def ramp_interp(spark, d):
    """Position of a ramp of 600 seconds between an event and the next, half way to the next one."""
    w = Window.partitionBy("user_id").orderBy(*EVENT_ORDER)
    t = F.expr(MICROS) / 1e6
    df = _events(spark, d).select("user_id", "event_id", "value", t.alias("t"), F.lead("value").over(w).alias("target"), F.lead(t).over(w).alias("next_t"))
    at = align.ramp(F.col("value"), F.col("target"), F.col("t"), F.lit(600.0), (F.col("t") + F.col("next_t")) / 2)
    return df.where("target is not null").select("user_id", "event_id", F.round(at, 4).alias("position"))


def ramp_interrupt(spark, d):
    """Ramps of two hours, each from where the one before has got to; unknown until one has ended."""
    e = _events(spark, d).select("user_id", (F.expr(MICROS) / 1e6).alias("t"), F.lit(7200.0).alias("d"), "value", "event_id")
    return align.interrupted_ramps(e, "user_id", "t", "d", "value", "event_id").select("user_id", "event_id", F.round("origin", 4).alias("origin"))


def motion_positions(spark, d):
    """Where ramps of two hours, begun by purchases, have got to at each click."""
    e = _events(spark, d).select("user_id", (F.expr(MICROS) / 1e6).alias("t"), F.lit(7200.0).alias("d"), "value", "event_id", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "t", "event_id")
    moves = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "arrival")
    return align.positions_at(clicks, moves, "user_id", "t", "d", "value", "arrival").select("user_id", "event_id", F.round("position", 4).alias("position"))


def xor_checksum(spark, d):
    """A4: an order-free checksum of each order's lines."""
    return _lines(spark, d).groupBy("l_orderkey").agg(levels.xor_fold(F.col("l_partkey"), F.col("l_linenumber")).alias("checksum"))


def next_interval_check(spark, d):
    """A5: whether an order's line count modulo 4 is what the next order's says."""
    per = _lines(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.sum("l_suppkey") % 4).alias("expected"))
    per = per.withColumn("actual", F.col("n") % 4).withColumn("stream", F.floor(F.col("l_orderkey") / 32).cast("bigint"))
    return levels.next_check(per, "stream", "l_orderkey", "expected", "actual").select("l_orderkey", "actual", "verdict")


def layer_agree(spark, d):
    """A10: whether all lines of an order have the same flag and status."""
    return levels.agreement(_lines(spark, d), "l_orderkey", ["l_returnflag", "l_linestatus"])


def fold_matrix(spark, d):
    """The first ten components folded from 5.1.4 to stereo."""
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    return mix.mix(df, "vec_id", "embedding", FOLD, 2).select("vec_id", "slot", F.round("value", 6).alias("value"))


def pan_gains(spark, d):
    """P17 in part: equal-power gains of one fixed pair of speakers, without the look-up of neighbours."""
    left, right = mix.pair_gains(F.col("value") / 50.0 - 1.0)
    return _events(spark, d).select("event_id", F.round(left, 6).alias("left_gain"), F.round(right, 6).alias("right_gain"))


def fir_residual(spark, d):
    """What a four-tap prediction leaves of scaled values."""
    e = _events(spark, d).withColumn("v", fx.round_half_away(F.col("value") * 100).cast("bigint"))
    return levels.residual(e, "user_id", EVENT_ORDER, "v", [900, -300, 150, -50], 10).select("user_id", "event_id", "v", "residual")


def quantize_clip(spark, d):
    """P10: values as 24-bit samples, with what was clipped."""
    sample, clipped = fx.quantize24(F.col("value") / 60.0 - 0.5)
    return _events(spark, d).select("event_id", sample.alias("sample"), clipped.alias("clipped"))


def coord_dequant(spark, d):
    """6-bit, 6-bit and signed 4-bit codes as coordinates."""
    x, y, z = fx.coordinate_x(F.col("p_partkey") % 64), fx.coordinate_y(F.col("p_partkey") % 61 + 3), fx.coordinate_z(F.col("p_partkey") % 2, F.col("p_size") % 16)
    return _parts(spark, d).select("p_partkey", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


def wave_mask(spark, d):
    """Channel masks of the named layouts."""
    return mix.channel_masks(mix.layout_table(spark))


def layouts(spark, d):
    """The speakers of the named layouts in slot order, and the rank at which each is displayed."""
    rank = {s: k for k, s in enumerate(mix.DISPLAY)}
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    shown = Window.partitionBy("layout").orderBy(ranks[F.col("speaker")])
    return mix.layout_table(spark).select("layout", "slot", "speaker", (F.row_number().over(shown) - 1).alias("shown"))


def room_gains(spark, d):
    """Gains of every slot of 5.1.4 for a place in the room."""
    x, y, z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50.0 - 1.0)), (F.col("event_id") % 41) / 20.0 - 1.0, (F.col("event_id") % 11) / 10.0
    gains = mix.speaker_gains("5.1.4", F.col("x"), F.col("y"), F.col("z"), F.lit(False))
    return _events(spark, d).select("event_id", x.alias("x"), y.alias("y"), z.alias("z")).select("event_id", F.posexplode(F.array(*gains)).alias("slot", "gain")).select("event_id", "slot", (F.round("gain", 6) + 0.0).alias("gain"))


def bed_downmix(spark, d):
    """An eight-channel bed in 5.1.2, whose heights stay silent."""
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    return mix.mix(df, "vec_id", "embedding", mix.bed_table("5.1.2"), 8).select("vec_id", "slot", F.round("value", 6).alias("value"))


def rendered(spark, d):
    """Elements that move, at one sample each second of an hour, in 5.1; silent where a place is unknown."""
    e = _events(spark, d).where("event_type in ('click', 'view')")
    e = e.select("user_id", "event_id", F.floor(F.col("value") * 100).alias("sample_value"), F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 3 - 1).cast("double")).alias("x"), (F.col("event_id") % 2).cast("double").alias("y"), F.lit(0.0).alias("z"), (F.col("event_id") % 5 == 0).alias("is_lfe"))
    out = mix.render(e, ["user_id"], "5.1", value="sample_value", gain=0.5)
    return out.select("user_id", "slot", F.round("value", 4).alias("value"), "available")


def cyclic_checks(spark, d):
    """Cyclic, parity and nibble checks of names."""
    data = F.col("p_name").cast("binary")
    return _parts(spark, d).select(
        "p_partkey", checksums.cyclic(data, 0x63, 8, 0x3C).alias("check8"), checksums.cyclic(data, 0x2D, 16).alias("check16"), checksums.byte_parity(data).alias("parity"), checksums.nibble_parity(F.col("p_partkey") * 257 % 65536).alias("nibble")
    )


def keyed_hash(spark, d):
    """Hashes of names under the caller's key."""
    return _parts(spark, d).select("p_partkey", checksums.hmac_sha256(F.col("p_name").cast("binary"), b"key").alias("mac"))


def restore(spark, d):
    """The values that a recursive filter restores from W2's residuals."""
    e = _events(spark, d).withColumn("v", fx.round_half_away(F.col("value") * 100).cast("bigint"))
    rest = levels.residual(e, "user_id", EVENT_ORDER, "v", [900, -300, 150, -50], 10)
    return levels.reconstruct(rest, "user_id", EVENT_ORDER, "residual", [900, -300, 150, -50], [], 10).select("user_id", "event_id", "restored")


def matrix_rows(spark, d):
    """Three channels after two rows, the second of which sees what the first put out."""
    state = F.array(*(F.col(c).cast("bigint") for c in ("l_partkey", "l_suppkey", "l_linenumber")))
    out = mix.sequential_rows(state, [(0, [5, -3, 7]), (2, [2, 1, -9])], 2)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", out[0].alias("a"), out[1].alias("b"), out[2].alias("c"))


def checked_arithmetic(spark, d):
    """P5: sums, products and scaled coefficients, null where they overflow."""
    key = F.col("p_partkey")
    # Where the inner product overflows, the outer one does too.
    product = fx.checked_multiply(fx.checked_multiply(key, F.lit(4_611_686_018_427)), key)
    total = fx.checked_multiply_add(key, F.lit(4_611_686_018_427_000), F.lit(9_200_000_000_000_000_000))
    return _parts(spark, d).select("p_partkey", product.alias("product"), total.alias("total"), fx.coefficient(key, 21).alias("coefficient"))


def energy(spark, d):
    """The energy of each user's values by kind of event."""
    return levels.energies(_events(spark, d), ["user_id", "event_type"], "value").select("user_id", "event_type", F.round("energy", 4).alias("energy"))


def level_gain(spark, d):
    """Dialogue codes as gains."""
    return _parts(spark, d).select("p_partkey", F.round(fx.dialogue_gain(F.col("p_size") % 32), 9).alias("gain"))


def checkpoint_seek(spark, d):
    """Of every eighth event of a user, the last one at or before the middle of the user's ids."""
    middle = F.floor((F.min("event_id").over(Window.partitionBy("user_id")) + F.max("event_id").over(Window.partitionBy("user_id"))) / 2).cast("bigint")
    return align.checkpoint_before(_events(spark, d).withColumn("middle", middle), "user_id", "event_id", "value", 8, F.col("middle"), ["event_id"])


def pending(spark, d):
    """Events due up to an hour later, in a queue of three."""
    t = F.expr(MICROS)
    e = _events(spark, d).select("user_id", "event_id", t.alias("t"), (t + F.floor(F.col("value") * 36_000_000)).alias("due"))
    return align.pending_events(e, "user_id", "t", "due", "event_id", 3).select("user_id", "event_id", "waiting", "fits")


def code_names(spark, d):
    """Names of speakers, statuses and backends."""
    return _parts(spark, d).select("p_partkey", mix.speaker_name(F.col("p_partkey") % 18).alias("speaker"), labels.status_name(F.col("p_partkey") % 15 - 1).alias("status"), labels.backend_name(F.col("p_partkey") % 7).alias("backend"))


def layer_ends(spark, d):
    """End markers behind layers, and what they trim from five samples."""
    k = F.col("p_partkey")
    word = F.when(k % 3 == 0, F.lit(0xD234)).when(k % 3 == 1, 0xE000 + k % 64).otherwise(k % 65536)
    tail = F.when(k % 7 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.format_string("%04X%04X", F.lit(0xD234), word.cast("int"))))
    end = _parts(spark, d).select("p_partkey", headers.end_of_layer(tail).alias("end"))
    left = headers.trimmed(F.sequence(F.lit(1), F.lit(40)), F.col("end.trim"))
    return end.select("p_partkey", "end.status", "end.ended", "end.trim", F.when(F.col("end.status") == "ok", F.size(left)).alias("n_samples"))


def level_report(spark, d):
    """Levels of events as the channels of 5.1, in another order and 6 dB down."""
    e = _events(spark, d).select(F.col("event_id").alias("sample"), (F.col("user_id") % 6).alias("slot"), (F.col("value") / 40.0 - 0.5).alias("value"))
    out = report.report(e, report.Options(layout="5.1", order=("FC", "FL", "FR", "SL", "SR", "LFE"), gain_db=-6.0))
    return out.select("slot", "n", "peak", F.round("rms", 6).alias("rms"), "clips")


def order_gate(spark, d):
    """whether ends rise within an order."""
    return levels.order_gate(_lines(spark, d), "l_orderkey", LINE_ORDER, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "rising")


def eos_tail(spark, d):
    """events after their user's first error."""
    return levels.after_end(_events(spark, d), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "end_at")


def unavailable_count(spark, d):
    """Events of a user before any code is known."""
    code = F.when(F.col("event_type") == "error", F.col("value"))
    held = align.hold(_events(spark, d), "user_id", EVENT_ORDER, code, "code")
    return held.groupBy("user_id").agg(F.count_if(F.col("code").isNull()).alias("unavailable"))


def integer_functions(spark, d):
    """Wrap, floor shift, 24-bit sign, cleared bits and timecodes."""
    x = F.col("l_partkey") * 1_234_567_891 - F.col("l_suppkey") * 98_765_432_123
    return _lines(spark, d).select("l_orderkey", "l_linenumber", fx.wrap32(x).alias("wrapped"), fx.floor_shift(x, 7).alias("shifted"), fx.pcm24(x).alias("pcm"), fx.clear_low_bits(x, 5).alias("cleared"), fx.timecode(F.col("l_orderkey") * 1_000_003).alias("timecode"))


def layer_select(spark, d):
    """One layer's programme peak, clip count, sample and unit counts."""
    e = _events(spark, d).where("event_type = 'view'")
    return e.groupBy((F.col("user_id") % 4).alias("layer")).agg(F.max(F.abs("value")).alias("peak"), F.count_if(F.col("value") > 50).alias("clips"), F.count(F.lit(1)).alias("samples"), F.countDistinct("user_id").alias("units"))


_W = "(partition by user_id order by ts, event_id)"
#: Written out, not taken from the tables that the code uses.
_SLOT = "coalesce(embedding[{}]::double, 0)"
_HALF = "0.7071067811865476"
_STEP = "list_reduce([{v}, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & {top} > 0 then xor((v << 1) & {all}, {poly}) else v << 1 end)"
_T8, _T16 = _STEP.format(v="i", top=128, all=255, poly=99), _STEP.format(v="i << 8", top=32768, all=65535, poly=45)


def _slots(key: str, slots: list[str], digits: int = 6) -> str:
    return " union all ".join(f"select {key}, {k} as slot, round({x}, {digits}) as value from embeddings" for k, x in enumerate(slots))


def _terms(*own: tuple[int, bool]) -> str:
    return " + ".join(_SLOT.format(i) + (f" * {_HALF}" if half else "") for i, half in own) or "0.0"


_XOR = "bit_xor(((l_partkey & 16777215) << (l_linenumber % 8)::bigint))"
_X = "(l_partkey * 1234567891 - l_suppkey * 98765432123)"
_RAMPS = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, value as x, row_number() over (partition by user_id order by ts, event_id) as n from events{where}),
r as (select user_id, event_id, n, t, x, null::double as origin from e where n = 1
union all select e.user_id, e.event_id, e.n, e.t, e.x, case when e.t - r.t >= 7200 then r.x else r.origin + (r.x - r.origin) * (e.t - r.t) / 7200 end from r join e on e.user_id = r.user_id and e.n = r.n + 1)"""

SQL = {
    "block_levels": f"""select user_id, block, count(*) as n, round(max(abs(value)), 6) as peak, round(sqrt(avg(value * value)), 6) as rms, count(*) filter (abs(value) > 50) as over
from (select *, (row_number() over {_W} - 1) // 40 as block from events) group by all""",
    "sample_clock": f"""select l_orderkey, l_linenumber, l_partkey, l_quantity::bigint as samples,
coalesce(sum(l_quantity::bigint) over (partition by l_orderkey order by {_LINES} rows between unbounded preceding and 1 preceding), 0)::bigint as first_sample from lineitem""",
    "asof_hold": """select c.user_id, c.event_id, epoch_us(c.ts) as t, p.held from (select * from events where event_type = 'click') c
asof left join (select user_id, ts, arg_max(value, event_id) as held from events where event_type = 'purchase' group by all) p on c.user_id = p.user_id and c.ts >= p.ts""",
    "inherit_fill": f"select user_id, event_id, last_value(case when event_type = 'error' then value end ignore nulls) over {_W[:-1]} rows between unbounded preceding and current row) as code from events",
    "ramp_interp": f"""select user_id, event_id, round(value + (target - value) * greatest(0, least(1, ((t + next_t) / 2 - t) / 600.0)), 4) as position
from (select *, epoch_us(ts) / 1e6 as t, lead(value) over {_W} as target, lead(epoch_us(ts) / 1e6) over {_W} as next_t from events) where target is not null""",
    "ramp_interrupt": f"{_RAMPS.format(where='')} select user_id, event_id, round(origin, 4) as origin from r",
    "xor_checksum": f"select l_orderkey, xor(xor(xor(x, x >> 8), x >> 16), x >> 24) & 255 as checksum from (select l_orderkey, {_XOR} as x from lineitem group by 1)",
    "next_interval_check": """select l_orderkey, n % 4 as actual, lead(expected) over (partition by l_orderkey // 32 order by l_orderkey) = n % 4 as verdict
from (select l_orderkey, count(*) as n, (sum(l_suppkey) % 4)::bigint as expected from lineitem group by 1)""",
    "layer_agree": "select l_orderkey, count(distinct l_returnflag) <= 1 and count(l_returnflag) in (0, count(*)) and count(distinct l_linestatus) <= 1 and count(l_linestatus) in (0, count(*)) as agree from lineitem group by 1",
    "fold_matrix": _slots("vec_id", [_terms((1, False), (3, True), (5, True), (7, True), (9, True)), _terms((2, False), (3, True), (6, True), (8, True), (10, True))]),
    "pan_gains": "select event_id, round(cos(a), 6) as left_gain, round(sin(a), 6) as right_gain from (select event_id, (greatest(-1, least(1, value / 50.0 - 1)) + 1) * pi() / 4 as a from events)",
    "fir_residual": f"""select user_id, event_id, v, v - ((coalesce(lag(v, 1) over {_W}, 0) * 900 - coalesce(lag(v, 2) over {_W}, 0) * 300 + coalesce(lag(v, 3) over {_W}, 0) * 150 - coalesce(lag(v, 4) over {_W}, 0) * 50) >> 10) as residual
from (select *, (sign(value) * floor(abs(value * 100) + 0.5))::bigint as v from events)""",
    "quantize_clip": "select event_id, (sign(v) * floor(abs(greatest(-8388608.0, least(8388607.0, v))) + 0.5))::bigint as sample, v > 8388607 or v < -8388608 as clipped from (select event_id, (value / 60.0 - 0.5) * 8388608.0 as v from events)",
    "coord_dequant": "select p_partkey, round(least(p_partkey % 64, 62) / 31.0::double - 1, 9) as x, round(1 - least(p_partkey % 61 + 3, 62) / 31.0::double, 9) as y, round((p_partkey % 2 * 2 - 1) * (p_size % 16) / 15.0::double, 9) as z from part",
    "wave_mask": """select layout, mask::bigint as mask from (values ('2.0', 3), ('5.1', 1551), ('5.1(back)', 63), ('5.1.2', 0), ('5.1.2(back)', 0), ('5.1.4', 185871), ('5.1.4(back)', 184383),
('7.1', 1599), ('7.1.2', 0), ('7.1.4', 185919), ('7.1.6', 0), ('9.1.6', 0)) t(layout, mask)""",
    "level_gain": "select p_partkey, round(pow(10.0, ((p_size % 32)::double - 31) / 20), 9) as gain from part",
    "checkpoint_seek": """select user_id, max(event_id) as checkpoint, arg_max(value, event_id) as state
from (select *, row_number() over (partition by user_id order by event_id) - 1 as rn, (min(event_id) over (partition by user_id) + max(event_id) over (partition by user_id)) // 2 as middle from events) where rn % 8 = 0 and event_id <= middle group by 1""",
    "order_gate": f"select l_orderkey, l_linenumber, l_partkey, case when row_number() over w = 1 then true else lag(l_partkey) over w < l_partkey end as rising from lineitem window w as (partition by l_orderkey order by {_LINES})",
    "eos_tail": "select user_id, event_id, end_at from (select *, min(case when event_type = 'error' then event_id end) over (partition by user_id) as end_at from events) where event_id > end_at",
    "unavailable_count": f"select user_id, count(*) filter (code is null) as unavailable from (select user_id, last_value(case when event_type = 'error' then value end ignore nulls) over {_W[:-1]} rows between unbounded preceding and current row) as code from events) group by 1",
    "integer_functions": f"""select l_orderkey, l_linenumber, (({_X} + 2147483648) & 4294967295) - 2147483648 as wrapped, {_X} >> 7 as shifted,
case when {_X} & 16777215 >= 8388608 then ({_X} & 16777215) - 16777216 else {_X} & 16777215 end as pcm, {_X} & -32 as cleared,
printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) as timecode from (select *, (l_orderkey * 1000003) // 48000 as s from lineitem)""",
    "layer_select": "select user_id % 4 as layer, max(abs(value)) as peak, count(*) filter (value > 50) as clips, count(*) as samples, count(distinct user_id) as units from events where event_type = 'view' group by 1",
    "motion_positions": f"""{_RAMPS.format(where=" where event_type = 'purchase'")}, last as (select * from r qualify row_number() over (partition by user_id, t order by n desc) = 1)
select c.user_id, c.event_id, round(case when c.t - l.t >= 7200 then l.x else l.origin + (l.x - l.origin) * (c.t - l.t) / 7200 end, 4) as position
from (select user_id, event_id, epoch_us(ts) / 1e6 as t from events where event_type = 'click') c asof left join last l on c.user_id = l.user_id and c.t >= l.t""",
    "layouts": """with l(layout, s) as (values ('2.0', 'FL FR'), ('5.1', 'FL FR FC LFE SL SR'), ('5.1(back)', 'FL FR FC LFE BL BR'), ('5.1.2', 'FL FR FC LFE SL SR TML TMR'), ('5.1.2(back)', 'FL FR FC LFE BL BR TML TMR'),
('5.1.4', 'FL FR FC LFE SL SR TFL TFR TBL TBR'), ('5.1.4(back)', 'FL FR FC LFE BL BR TFL TFR TBL TBR'), ('7.1', 'FL FR FC LFE BL BR SL SR'), ('7.1.2', 'FL FR FC LFE BL BR SL SR TML TMR'),
('7.1.4', 'FL FR FC LFE BL BR SL SR TFL TFR TBL TBR'), ('7.1.6', 'FL FR FC LFE BL BR SL SR TFL TFR TBL TBR TML TMR'), ('9.1.6', 'FL FR FC LFE BL BR SL SR TFL TFR TBL TBR TML TMR FWL FWR')),
f as (select layout, unnest(range(len(string_split(s, ' ')))) as slot, unnest(string_split(s, ' ')) as speaker from l)
select layout, slot::int as slot, speaker, (row_number() over (partition by layout order by position(' ' || speaker || ' ' in ' FL FR FC LFE SL SR BL BR FWL FWR TFL TFR TML TMR TBL TBR ')) - 1)::int as shown from f""",
    "room_gains": """with s(slot, x, y, z) as (values (0, -1, 1, 0), (1, 1, 1, 0), (2, 0, 1, 0), (4, -1, 0, 0), (5, 1, 0, 0), (6, -1, 1, 1), (7, 1, 1, 1), (8, -1, -1, 1), (9, 1, -1, 1)),
p as (select event_id, greatest(-1, least(1, value / 50 - 1)) as px, (event_id % 41) / 20.0::double - 1 as py, (event_id % 11) / 10.0::double as pz from events),
r as (select p.*, z, greatest(lo, least(hi, py)) as cy from p, (select z, min(y) as lo, max(y) as hi from s group by z)),
n as (select event_id, px, pz, z, cy, max(y) filter (y <= cy) as ya, min(y) filter (y >= cy) as yb from r join s using (z) group by all),
w as (select n.*, y, case when ya = yb then 1 when y = ya then cos((cy - ya) / (yb - ya) * pi() / 2) else sin((cy - ya) / (yb - ya) * pi() / 2) end as wy from n join (select distinct z, y from s) using (z) where y in (ya, yb)),
c as (select event_id, pz, z, y, wy, max(x) filter (x <= px) as xa, min(x) filter (x >= px) as xb, any_value(px) as px from w join s using (z, y) group by all),
g as (select event_id, slot, wy * case when xa = xb then 1 when x = xa then cos((px - xa) / (xb - xa) * pi() / 2) else sin((px - xa) / (xb - xa) * pi() / 2) end * case when z = 0 then cos(pz * pi() / 2) else sin(pz * pi() / 2) end as gain
  from c join s using (z, y) where x in (xa, xb))
select event_id, slot::int as slot, round(coalesce(gain, 0), 6) + 0.0 as gain from (select event_id, unnest(range(10)) as slot from events) left join g using (event_id, slot)""",
    "bed_downmix": _slots("vec_id", [_terms((1, False)), _terms((2, False)), _terms((3, False)), _terms((4, False)), _terms((5, True), (7, True)), _terms((6, True), (8, True)), _terms(), _terms()]),
    "rendered": """with e as (select user_id, event_id, floor(value * 100) as v, event_id % 3 - 1 as x, event_id % 2 as y, event_id % 5 = 0 as lfe, event_id % 17 = 0 and event_id % 5 <> 0 as lost from events where event_type in ('click', 'view')),
s(slot, x, y) as (values (0, -1, 1), (1, 1, 1), (2, 0, 1), (3, null, null), (4, -1, 0), (5, 1, 0)),
t as (select user_id, slot, bool_or(lost) as lost, sum(case when slot = 3 then (case when lfe then v else 0 end) when lfe then 0 when e.y = 0 and e.x = 0 and s.y = 0 then v * sqrt(0.5) when e.x = s.x and e.y = s.y then v else 0 end) as total from e, s group by 1, 2)
select user_id, slot::int as slot, round(case when lost then 0 else total * 0.5 end, 4) as value, not lost as available from t""",
    "cyclic_checks": f"""with t as (select list_transform(range(256), lambda i: {_T8}) as t8, list_transform(range(256), lambda i: {_T16}) as t16),
b as (select p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::bigint) as b from part)
select p_partkey, list_reduce([0::bigint] || [xor(b[1], 60)] || b[2:], lambda v, x: xor(t8[v + 1], x)) as check8,
list_reduce([0::bigint] || b, lambda v, x: xor(xor(t16[(v >> 8) + 1], (v << 8) & 65535), x)) as check16, list_reduce(b, lambda v, x: xor(v, x))::int as parity,
(with n as (select p_partkey * 257 % 65536 as k) select xor(xor(k >> 12, (k >> 8) & 15), xor((k >> 4) & 15, k & 15)) from n) as nibble from b, t""",
    "keyed_hash": f"""select p_partkey, sha256(from_hex('{"373925" + "5c" * 61}') || from_hex(sha256(from_hex('{"5d534f" + "36" * 61}') || encode(p_name)))) as mac from part""",
    "restore": "select user_id, event_id, (sign(value) * floor(abs(value * 100) + 0.5))::bigint as restored from events",
    "matrix_rows": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, a, l_suppkey as b, (2 * a + l_suppkey - 9 * l_linenumber) >> 2 as c from (select *, (5 * l_partkey - 3 * l_suppkey + 7 * l_linenumber) >> 2 as a from lineitem)",
    "checked_arithmetic": """select p_partkey, case when p_partkey::hugeint * 4611686018427 * p_partkey <= 9223372036854775807 then (p_partkey::hugeint * 4611686018427 * p_partkey)::bigint end as product,
case when p_partkey::hugeint * 4611686018427000 + 9200000000000000000 <= 9223372036854775807 then (p_partkey::hugeint * 4611686018427000 + 9200000000000000000)::bigint end as total,
case when p_partkey * 2097152 <= 2147483647 then p_partkey * 2097152 end as coefficient from part""",
    "pending": """with e as (select user_id, event_id, epoch_us(ts) as t, epoch_us(ts) + floor(value * 36000000)::bigint as due from events)
select a.user_id, a.event_id, count(b.event_id) as waiting, count(b.event_id) < 3 as fits from e a
left join e b on a.user_id = b.user_id and (b.t < a.t or b.t = a.t and b.event_id < a.event_id) and greatest(b.t, b.due) >= a.t group by 1, 2""",
    "code_names": """select p_partkey, coalesce(['FL', 'FR', 'FC', 'LFE', 'BL', 'BR', 'SL', 'SR', 'TFL', 'TFR', 'TBL', 'TBR', 'TML', 'TMR', 'FWL', 'FWR'][p_partkey % 18 + 1], 'unknown') as speaker,
case when p_partkey % 15 = 0 then 'unknown status' else coalesce(['ok', 'invalid argument', 'corrupt stream', 'unsupported stream profile', 'restart required', 'buffer too small', 'device unavailable', 'unknown speaker layout',
'out of memory', 'unsupported audio output', 'native audio failure', 'audio timeout', 'cancelled'][p_partkey % 15], 'unknown status') end as status,
coalesce(['unavailable', 'CoreAudio', 'WASAPI', 'Windows Spatial Audio', 'PipeWire', 'ALSA'][p_partkey % 7 + 1], 'unknown') as backend from part""",
    "layer_ends": """with w as (select p_partkey, p_partkey % 7 = 0 as goes_on, case p_partkey % 3 when 0 then 53812 when 1 then 57344 + p_partkey % 64 else p_partkey % 65536 end as w from part),
v as (select *, not goes_on and w >= 57344 and w - 57344 < 40 as cut, not goes_on and w = 53812 as whole from w)
select p_partkey, case when goes_on or cut or whole then 'ok' else 'corrupt' end as status, cut or whole as ended, case when cut then w - 57344 when goes_on or whole then 0 end::int as trim,
case when cut then 40 - (w - 57344) when goes_on or whole then 40 end::int as n_samples from v""",
    "level_report": """select [1, 2, 0, 5, 3, 4][user_id % 6 + 1] as slot, count(*) as n, max(abs(v))::bigint as peak, round(sqrt(avg((v / 8388608.0) * (v / 8388608.0))), 6) as rms, count(*) filter (s > 8388607 or s < -8388608) as clips
from (select *, sign(s) * floor(abs(greatest(-8388608.0, least(8388607.0, s))) + 0.5) as v from (select user_id, (value / 40 - 0.5) * pow(10.0, -0.3) * 8388608.0 as s from events)) group by 1""",
    "energy": "select user_id, event_type, round(sum(value * value), 4) as energy from events group by 1, 2",
}

QUERIES = {name: globals()[name] for name in SQL}
