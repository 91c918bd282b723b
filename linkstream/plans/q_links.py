"""Registered queries: link table."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkstream.operators import links as L
from linkstream.plans.oracle_fixtures import with_views as V
from linkstream.plans.registry import query
from linkstream.sources import fixtures as FX
from linkstream.sources.tables import Tables

# Independent statement of the ordered replay: a recursive walk over lives.
# A life starts at the first insert of an id, or at the first insert after
# the delete that ended the previous life; it ends at the first delete by
# its owner after its start.
def _lives_sql(with_init: bool) -> str:
    """Replay as a recursive walk over lives.  A life starts at the first
    insert of an id, or at the first insert after the delete that ended the
    previous life; it ends at the first delete by its owner after its start.
    With ``with_init`` the current link table enters as inserts ordered
    before every mutation (o0 = 0)."""
    init = """
  union all select id, 'insert', long_url, user_id, created_at, -1, 0 from url_mappings""" if with_init else ""
    views = V("link_mutations", "url_mappings", recursive=True) if with_init else V("link_mutations", recursive=True)
    return views + f""",
evs as (select id, op, long_url, user_id, commit_ts, seq, 1 as o0 from link_mutations{init}),
ins as (select * from evs where op = 'insert'),
dels as (select * from evs where op = 'delete'),
lives(id, o0, ts, seq, owner) as (
  select id, o0, commit_ts, seq, user_id from (
    select *, row_number() over (partition by id order by o0, commit_ts, seq) as rn from ins) where rn = 1
  union all
  select i.id, i.o0, i.commit_ts, i.seq, i.user_id from (
    select e.id, min({{'o0': i.o0, 'ts': i.commit_ts, 'seq': i.seq}}) as ipos from (
      select l.id, min({{'o0': d.o0, 'ts': d.commit_ts, 'seq': d.seq}}) as dpos from lives l join dels d
        on d.id = l.id and d.user_id = l.owner
       and {{'o0': d.o0, 'ts': d.commit_ts, 'seq': d.seq}} > {{'o0': l.o0, 'ts': l.ts, 'seq': l.seq}}
      group by l.id) e
    join ins i on i.id = e.id and {{'o0': i.o0, 'ts': i.commit_ts, 'seq': i.seq}} > e.dpos
    group by e.id) x
  join ins i on i.id = x.id and i.o0 = x.ipos.o0 and i.commit_ts = x.ipos.ts and i.seq = x.ipos.seq
),
lives_full as (
  select l.id, l.o0, l.ts, l.seq, l.owner,
    (select min({{'o0': d.o0, 'ts': d.commit_ts, 'seq': d.seq}}) from dels d
      where d.id = l.id and d.user_id = l.owner
        and {{'o0': d.o0, 'ts': d.commit_ts, 'seq': d.seq}} > {{'o0': l.o0, 'ts': l.ts, 'seq': l.seq}}) as endpos
  from lives l
),
ev as (
  select m.*, {{'o0': m.o0, 'ts': m.commit_ts, 'seq': m.seq}} as pos, lf.endpos as start_end,
    lf.id is not null as is_start
  from evs m left join lives_full lf on lf.id = m.id and lf.o0 = m.o0 and lf.ts = m.commit_ts and lf.seq = m.seq
),
cov as (
  select *,
    last_value(case when is_start then {{'owner': user_id, 'endpos': start_end, 'created': commit_ts}} end ignore nulls)
      over (partition by id order by o0, commit_ts, seq rows between unbounded preceding and current row) as life
  from ev
),
verdict as (
  select *,
    coalesce(case op when 'insert' then is_start
            when 'update' then life is not null and (life.endpos is null or pos < life.endpos)
                               and user_id is not null and user_id = life.owner
            when 'delete' then life is not null and life.endpos = pos
            else false end, false) as accepted,
    life is not null and (life.endpos is null or pos < life.endpos) as alive
  from cov
)
"""


_LIVES = _lives_sql(False)
_FINAL_LINKS = """
select id, s.url as long_url, s.owner as user_id, s.created as created_at from (
  select id, arg_max({'url': long_url, 'owner': life.owner, 'created': life.created, 'endpos': life.endpos}, pos) as s
  from verdict where accepted and op in ('insert', 'update') group by id) where s.endpos is null"""


@query("apply_mutations_applied", "J6", _LIVES + """
select id, op, long_url, user_id, commit_ts, seq from verdict where accepted and o0 = 1""")
def q_apply_applied(spark, sf):
    _, applied, _ = L.apply_mutations(None, FX.link_mutations(Tables(spark, sf)))
    return applied


@query("apply_mutations_rejected", "J6", _LIVES + """
select id, op, long_url, user_id, commit_ts, seq,
  case when op = 'insert' then 'already_exists' when not alive then 'not_found' else 'not_owner' end as reason
from verdict where not accepted and o0 = 1""")
def q_apply_rejected(spark, sf):
    _, _, rejected = L.apply_mutations(None, FX.link_mutations(Tables(spark, sf)))
    return rejected


@query("apply_mutations_links", "J6", _LIVES + _FINAL_LINKS)
def q_apply_links(spark, sf):
    final, _, _ = L.apply_mutations(None, FX.link_mutations(Tables(spark, sf)))
    return final


@query("apply_mutations_on_links", "M1-M3, J6", _lives_sql(True) + _FINAL_LINKS)
def q_apply_on_links(spark, sf):
    """Replay the mutation log on top of the existing link table."""
    t = Tables(spark, sf)
    final, _, _ = L.apply_mutations(FX.url_mappings(t), FX.link_mutations(t))
    return final


@query("insert_links", "M1", V("url_mappings") + """
select id, long_url, user_id, created_at from url_mappings""")
def q_insert_links(spark, sf):
    """Insert every link into an empty table: all succeed (unique ids)."""
    t = Tables(spark, sf)
    rows = FX.url_mappings(t).select("id", "long_url", "user_id", F.col("created_at").alias("commit_ts"),
                                     F.lit(0).cast("bigint").alias("seq"))
    final, _, _ = L.insert_links(None, rows)
    return final


@query("latest_state", "W4", V("link_mutations") + """
select id, s.long_url as long_url, s.user_id as user_id, s.commit_ts as updated_at from (
  select id, max({'commit_ts': commit_ts, 'seq': seq, 'op': op, 'long_url': long_url, 'user_id': user_id}) as s
  from link_mutations group by id) where s.op <> 'delete'""")
def q_latest_state(spark, sf):
    return L.latest_state(FX.link_mutations(Tables(spark, sf)))


@query("links_as_of", "J3", V("link_mutations") + """
select id, s.long_url as long_url, s.user_id as user_id, s.commit_ts as updated_at from (
  select id, max({'commit_ts': commit_ts, 'seq': seq, 'op': op, 'long_url': long_url, 'user_id': user_id}) as s
  from link_mutations where commit_ts <= timestamp '1995-06-30 00:00:00' group by id) where s.op <> 'delete'""")
def q_links_as_of(spark, sf):
    return L.links_as_of(FX.link_mutations(Tables(spark, sf)), "1995-06-30 00:00:00")


@query("diff_links", "M4", V("link_mutations") + """,
snap_old as (select id, s.long_url as long_url, s.user_id as user_id from (
  select id, max({'commit_ts': commit_ts, 'seq': seq, 'op': op, 'long_url': long_url, 'user_id': user_id}) as s
  from link_mutations where commit_ts <= timestamp '1995-06-30 00:00:00' group by id) where s.op <> 'delete'),
snap_new as (select id, s.long_url as long_url, s.user_id as user_id from (
  select id, max({'commit_ts': commit_ts, 'seq': seq, 'op': op, 'long_url': long_url, 'user_id': user_id}) as s
  from link_mutations group by id) where s.op <> 'delete')
select coalesce(o.id, n.id) as id,
  case when o.id is null then 'inserted' when n.id is null then 'deleted' else 'updated' end as change,
  o.long_url as old_url, n.long_url as new_url
from snap_old o full outer join snap_new n on o.id = n.id
where o.id is null or n.id is null or o.long_url is distinct from n.long_url or o.user_id is distinct from n.user_id""")
def q_diff_links(spark, sf):
    t = Tables(spark, sf)
    log = FX.link_mutations(t)
    return L.diff_links(L.links_as_of(log, "1995-06-30 00:00:00"), L.latest_state(log))


@query("read_links", "S7", V("url_mappings") + "select * from url_mappings")
def q_read_links(spark, sf):
    return FX.url_mappings(Tables(spark, sf))


@query("lookup_by_code", "P8", V("url_mappings", "redirect_requests") + """
select distinct r.short_code, m.long_url from redirect_requests r join url_mappings m on m.id = r.short_code""")
def q_lookup_by_code(spark, sf):
    t = Tables(spark, sf)
    return L.lookup_by_code(FX.url_mappings(t), FX.redirect_requests(t))


@query("filter_user", "P9", V("url_mappings") + "select * from url_mappings where user_id = 'user3'")
def q_filter_user(spark, sf):
    return L.filter_user(FX.url_mappings(Tables(spark, sf)), "user3")


@query("user_history", "T3", V("url_mappings") + """
select id, long_url, created_at, row_number() over (order by created_at desc, id) as rank
from url_mappings where user_id = 'user3'""")
def q_user_history(spark, sf):
    return L.user_history(FX.url_mappings(Tables(spark, sf)), "user3")


@query("require_user", "P12", V("url_mappings") + """
select *, case when user_id is null or user_id = '' then 'unauthorized' end as reason from url_mappings""")
def q_require_user(spark, sf):
    return L.require_user(FX.url_mappings(Tables(spark, sf)))


@query("display_columns", "P13", V("url_mappings") + """
select id, strftime(created_at, '%b %-d, %Y') as created_display,
  format('{:,}', cast(length(long_url) * 1000 as bigint)) as clicks_display from url_mappings""")
def q_display_columns(spark, sf):
    m = FX.url_mappings(Tables(spark, sf)).withColumn("n", (F.length("long_url") * 1000).cast("bigint"))
    return L.display_columns(m, "created_at", "n").select("id", "created_display", "clicks_display")


@query("apply_retention", "M5", V("redirect_requests") + """
select * from redirect_requests where ts >= timestamp '2024-01-30 23:59:59' - interval 7 days""")
def q_apply_retention(spark, sf):
    return L.apply_retention(FX.redirect_requests(Tables(spark, sf)), "ts", FX.NOW, "7 DAYS")


@query("expire_links", "M6", V("url_mappings") + """
select * from url_mappings where created_at + interval 2 hours > timestamp '2024-01-01 02:30:00'""")
def q_expire_links(spark, sf):
    return L.expire_links(FX.url_mappings(Tables(spark, sf)), "2024-01-01 02:30:00", "2 HOURS")


# Owner edits derived from pages: every page's owner asks to change or remove
# its link; anonymous and deleted links must refuse.
_EDIT_SQL = V("url_mappings") + """,
edits as (select lpad(cast(page_id as varchar(20)), 11, '0') as id, url || '?v=2' as long_url,
  'user' || cast(page_id % 20 as varchar) as user_id,
  timestamp '2024-01-01 00:00:00' + interval '1' minute * page_id + interval 1 day as commit_ts,
  page_id as seq from pages)
"""


def _edits(t, which):
    from linkstream.sources.fixtures import BASE_TS, code_of
    p = t("pages")
    if which == "delete":
        p = p.where(F.col("page_id") % 2 == 0)
    ts = (F.to_timestamp(F.lit(BASE_TS)) + F.make_dt_interval(F.lit(1), F.lit(0), F.col("page_id").cast("int")))
    return p.select(code_of("page_id").alias("id"), F.concat("url", F.lit("?v=2")).alias("long_url"),
                    F.concat(F.lit("user"), (F.col("page_id") % 20).cast("string")).alias("user_id"),
                    ts.alias("commit_ts"), F.col("page_id").alias("seq"))


@query("update_links", "M2", _EDIT_SQL + """
select m.id, case when m.user_id is not null and m.user_id = e.user_id then e.long_url else m.long_url end as long_url,
  m.user_id, m.created_at from url_mappings m left join edits e on e.id = m.id""")
def q_update_links(spark, sf):
    t = Tables(spark, sf)
    final, _, _ = L.update_links(FX.url_mappings(t), _edits(t, "update"))
    return final


@query("delete_links", "M3", _EDIT_SQL + """
select m.* from url_mappings m where not exists (select 1 from edits e where e.id = m.id and e.seq % 2 = 0
  and m.user_id is not null and m.user_id = e.user_id)""")
def q_delete_links(spark, sf):
    t = Tables(spark, sf)
    final, _, _ = L.delete_links(FX.url_mappings(t), _edits(t, "delete"))
    return final


@query("stale_read", "J3", V("link_mutations") + """
select id, s.long_url as long_url, s.user_id as user_id, s.commit_ts as updated_at from (
  select id, max({'commit_ts': commit_ts, 'seq': seq, 'op': op, 'long_url': long_url, 'user_id': user_id}) as s
  from link_mutations where commit_ts <= timestamp '1996-01-01 00:00:00' - interval 15 second group by id)
where s.op <> 'delete'""")
def q_stale_read(spark, sf):
    return L.stale_read(FX.link_mutations(Tables(spark, sf)), "1996-01-01 00:00:00", "15 seconds")
