"""Registered queries: short-code maths and bulk assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstream.constants import (
    BASE62_ALPHABET, FEISTEL_MUL_1, FEISTEL_MUL_2, FEISTEL_ROUND_KEY, FEISTEL_ROUNDS,
    FEISTEL_SHIFT_1, FEISTEL_SHIFT_2, SNOWFLAKE_EPOCH_MS,
)
from linkstream.functions import codes as K
from linkstream.operators import keygen as G
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables

_M = 4294967296
_POWERS = ", ".join(str(62 ** k) + "::UBIGINT" for k in range(10, -1, -1))


def _sql_round(v: str, r: int) -> str:
    """DuckDB text of one Feistel round function on UBIGINT ``v``."""
    x = f"xor({v}, {FEISTEL_ROUND_KEY ^ r}::UBIGINT)"
    m1 = f"(({x}) * {FEISTEL_MUL_1}::UBIGINT) % {_M}::UBIGINT"
    x2 = f"xor({m1}, ({m1}) >> {FEISTEL_SHIFT_1})"
    m2 = f"(({x2}) * {FEISTEL_MUL_2}::UBIGINT) % {_M}::UBIGINT"
    return f"xor({m2}, ({m2}) >> {FEISTEL_SHIFT_2})"


def _sql_feistel(src: str, prefix: str, inverse: bool = False) -> str:
    """CTE chain ``{prefix}0..{prefix}4`` over (k, hi, lo) starting at ``src``."""
    parts = [f"{prefix}0 as (select * from {src})"]
    rounds = range(FEISTEL_ROUNDS - 1, -1, -1) if inverse else range(FEISTEL_ROUNDS)
    for i, r in enumerate(rounds, start=1):
        prev = f"{prefix}{i - 1}"
        if inverse:
            parts.append(f"{prefix}{i} as (select k, xor(lo, {_sql_round('hi', r)}) as hi, hi as lo from {prev})")
        else:
            parts.append(f"{prefix}{i} as (select k, lo as hi, xor(hi, {_sql_round('lo', r)}) as lo from {prev})")
    return ",\n".join(parts)


def _sql_b62(x: str) -> str:
    return (f"array_to_string(list_transform([{_POWERS}], lambda p: substr('{BASE62_ALPHABET}', "
            f"cast((({x}) // p) % 62 as int) + 1, 1)), '')")


def _sql_b62_decode(c: str) -> str:
    return (f"cast(list_sum(list_transform(range(11), lambda i: cast(instr('{BASE62_ALPHABET}', substr({c}, i + 1, 1)) - 1 as hugeint)"
            f" * [{_POWERS}][i + 1])) % 18446744073709551616 as ubigint)")


_ROUNDTRIP_SQL = "with ids as (select o_orderkey as k, cast(o_orderkey as ubigint) >> 32 as hi, " \
    f"cast(o_orderkey as ubigint) % {_M}::UBIGINT as lo from orders),\n" + _sql_feistel("ids", "f") + """,
obf as (select k, hi * 4294967296::UBIGINT + lo as v from f4),
coded as (select o.k, o.v, """ + _sql_b62("o.v") + """ as code from obf o),
dec as (select k, v, code, """ + _sql_b62_decode("code") + """ as d from coded),
inv_in as (select k, d >> 32 as hi, d % 4294967296::UBIGINT as lo from dec),
""" + _sql_feistel("inv_in", "g", inverse=True) + """
select i.k as id, """ + _sql_b62("cast(i.k as ubigint)") + """ as code_plain, cast(d.v as varchar) as obfuscated,
  d.code as short_code, cast(d.d as varchar) as decoded, cast(g4.hi * 4294967296::UBIGINT + g4.lo as bigint) as restored
from ids i join dec d on d.k = i.k join g4 on g4.k = i.k"""


@query("short_code_roundtrip", "H4-H7", _ROUNDTRIP_SQL)
def q_roundtrip(spark, sf):
    o = Tables(spark, sf)("orders").select(F.col("o_orderkey").alias("id"))
    h = K.halves_from_long("id")
    df = o.select("id", K.base62_encode(h["hi"], h["lo"]).alias("code_plain"),
                  K.feistel_obfuscate(h["hi"], h["lo"]).alias("_obf"))
    df = df.select("id", "code_plain", "_obf",
                   K.halves_to_decimal(F.col("_obf.hi"), F.col("_obf.lo")).cast("string").alias("obfuscated"),
                   K.base62_encode(F.col("_obf.hi"), F.col("_obf.lo")).alias("short_code"),
                   K.feistel_invert(F.col("_obf.hi"), F.col("_obf.lo")).alias("_inv"))
    dec = K.base62_decode("short_code", general=False)
    return df.select("id", "code_plain", "obfuscated", "short_code",
                     K.halves_to_decimal(dec["hi"], dec["lo"]).cast("string").alias("decoded"),
                     F.shiftleft(F.col("_inv.hi"), 32).bitwiseOR(F.col("_inv.lo")).alias("restored"))


_REBASE_MS = "(epoch_ms(o_orderdate) - epoch_ms(timestamp '1992-01-01 00:00:00'))"


@query("cycle_walk", "H8", "with ids as (select o_orderkey as k, cast(o_orderkey as ubigint) >> 32 as hi, "
       f"cast(o_orderkey as ubigint) % {_M}::UBIGINT as lo from orders),\n" + _sql_feistel("ids", "f") + """
select k as id, cast(hi as bigint) as hi, cast(lo as bigint) as lo from f4""")
def q_cycle_walk(spark, sf):
    df = Tables(spark, sf)("orders").select(F.col("o_orderkey").alias("id"))
    h = K.halves_from_long("id")
    return df.withColumn("w", K.cycle_walk(h["hi"], h["lo"])).select("id", "w.hi", "w.lo")


@query("snowflake_roundtrip", "H9-H10", f"""
with s as (select o_orderkey as k, {SNOWFLAKE_EPOCH_MS} + {_REBASE_MS} + o_orderkey % 1000 as ms,
  o_custkey % 1024 as node, o_orderkey % 4096 as seq from orders)
select k as id, ((ms - {SNOWFLAKE_EPOCH_MS}) << 22) | (node << 12) | seq as snowflake,
  make_timestamp(ms * 1000) as ts, cast(node as int) as node, cast(seq as int) as seq from s""")
def q_snowflake(spark, sf):
    o = Tables(spark, sf)("orders")
    ms = (F.lit(SNOWFLAKE_EPOCH_MS) + F.unix_millis("o_orderdate")
          - F.unix_millis(F.to_timestamp(F.lit("1992-01-01 00:00:00"))) + F.col("o_orderkey") % 1000)
    df = o.select(F.col("o_orderkey").alias("id"),
                  K.snowflake_compose(ms, F.col("o_custkey") % 1024, F.col("o_orderkey") % 4096).alias("snowflake"))
    dec = K.snowflake_decode("snowflake")
    return df.select("id", "snowflake", dec["ts"].alias("ts"), dec["node"].alias("node"), dec["seq"].alias("seq"))


_VALID_SQL = V("shorten_requests") + """,
v as (select request_id, user_id,
  case when json_valid(body) then json_extract_string(body, '$.long_url') end as long_url,
  case when json_valid(body) then json_extract_string(body, '$.custom_slug') end as custom_slug,
  case when not json_valid(body) then 'invalid_request_body'
       when coalesce(json_extract_string(body, '$.long_url'), '') = '' then 'missing_long_url' end as reason
  from shorten_requests),
ok as (select *, coalesce(user_id, '') <> '' and coalesce(custom_slug, '') <> '' as use_custom
       from v where reason is null),
gen as (select request_id, row_number() over (order by request_id) - 1 + 5000 as id from ok where not use_custom)
"""


def _validated(spark, sf):
    return G.validate_requests(FX.shorten_requests(Tables(spark, sf)))


@query("validate_requests", "P5", _VALID_SQL + """
select request_id, user_id, long_url, custom_slug, reason, case when reason is null then 201 else 400 end as status
from v""")
def q_validate(spark, sf):
    return _validated(spark, sf)


@query("choose_slug", "P6", _VALID_SQL + "select request_id, use_custom from ok")
def q_choose_slug(spark, sf):
    return G.choose_slug(_validated(spark, sf).where(F.col("reason").isNull())).select("request_id", "use_custom")


def _assigned(spark, sf, obfuscate=True, start=5000):
    ok = G.choose_slug(_validated(spark, sf).where(F.col("reason").isNull()))
    return G.assign_short_codes(ok, "request_id", start_id=start, obfuscate=obfuscate)


_OBF_SQL = _VALID_SQL + """,
ids as (select request_id as k, cast(id as ubigint) >> 32 as hi, cast(id as ubigint) % 4294967296::UBIGINT as lo
        from gen),
""" + _sql_feistel("ids", "f") + """,
coded as (select k as request_id, """ + _sql_b62("hi * 4294967296::UBIGINT + lo") + """ as short_code from f4)
"""


@query("assign_short_codes", "K1", _OBF_SQL + """
select g.request_id, g.id, cast(floor((g.id - 5000) / 1000000) as bigint) as block_id, c.short_code
from gen g join coded c on c.request_id = g.request_id
union all
select request_id, cast(null as bigint), cast(null as bigint), custom_slug from ok where use_custom""")
def q_assign(spark, sf):
    return _assigned(spark, sf).select("request_id", "id", "block_id", "short_code")


@query("assign_short_codes_snowflake", "K2", _VALID_SQL + """
select request_id, not use_custom as generated, true as code_ok from ok""")
def q_assign_snowflake(spark, sf):
    """Each request's code: its own slug, or the one that its id spells."""
    ok = G.choose_slug(_validated(spark, sf).where(F.col("reason").isNull()))
    coded = G.assign_short_codes(ok, "request_id", mode="snowflake", batch_ms=SNOWFLAKE_EPOCH_MS + 86_400_000)
    code = K.base62_decode("short_code")
    spelled = F.when(F.col("id").isNull(), F.col("short_code") == F.col("custom_slug")).otherwise(
        F.shiftleft(code["hi"], 32) + code["lo"] == F.col("id"))
    return coded.select("request_id", F.col("id").isNotNull().alias("generated"), spelled.alias("code_ok"))


@query("snowflake_batches", "K2", _VALID_SQL + """
select request_id, batch, true as in_time, true as node_ok, true as code_ok, cast(1 as bigint) as rows_of_id
from ok, range(2) b(batch) where not use_custom""")
def q_snowflake_batches(spark, sf):
    """Two batches of the same millisecond: each id comes once, its parts and
    its code decode to what went in."""
    ok = G.choose_slug(_validated(spark, sf).where(F.col("reason").isNull())).where(~F.col("use_custom"))
    start = SNOWFLAKE_EPOCH_MS + 86_400_000
    first = G.assign_short_codes(ok, "request_id", mode="snowflake", batch_ms=start)
    second = G.assign_short_codes(ok, "request_id", mode="snowflake", batch_ms=start, last_ms=G.last_millisecond(first))
    both = first.withColumn("batch", F.lit(0).cast("bigint")).unionByName(second.withColumn("batch", F.lit(1).cast("bigint")))
    part, code = K.snowflake_decode("id"), K.base62_decode("short_code")
    ids = both.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("rows_of_id"))
    return both.join(ids, F.col("id") == F.col("_id")).select(
        "request_id", "batch", (F.unix_millis(part["ts"]) >= start).alias("in_time"), part["node"].between(0, 1023).alias("node_ok"),
        ((F.shiftleft(code["hi"], 32) + code["lo"]) == F.col("id")).alias("code_ok"), "rows_of_id")


@query("build_short_url", "P7", _OBF_SQL + """
select c.request_id, 'https://sho.rt/' || c.short_code as short_url, 'sho.rt/' || c.short_code as short_url_display from coded c
union all select request_id, 'https://sho.rt/' || custom_slug, 'sho.rt/' || custom_slug from ok where use_custom""")
def q_build_short_url(spark, sf):
    return G.with_short_url(_assigned(spark, sf), "https://sho.rt/").select("request_id", "short_url", "short_url_display")


@query("code_collisions", "K3", _VALID_SQL + """,
plain as (select g.request_id, """ + _sql_b62("cast(g.id - 5000 as ubigint)") + """ as short_code from gen g
          union all select request_id, custom_slug from ok where use_custom),
links as (select lpad(cast(page_id as varchar(20)), 11, '0') as id from pages where page_id % 7 <> 3)
select short_code, 'duplicate_in_batch' as kind from plain group by short_code having count(*) > 1
union all
select distinct short_code, 'exists_in_table' from plain where short_code in (select id from links)""")
def q_collisions(spark, sf):
    new = _assigned(spark, sf, obfuscate=False, start=0)
    return G.code_collisions(new, FX.url_mappings(Tables(spark, sf)))
