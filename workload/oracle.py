"""The same queries as DuckDB SQL, written from their definitions rather than from the Spark plans:
windows sort whole series, kernels add up every (sample, event) pair, medians use ``median``."""

from __future__ import annotations

# The number inside the text of events.props.
K = "try_cast(regexp_replace(props, '[^0-9eE+\\-.]', '', 'g') as double)"
EK = f"(select *, {K} as k from events)"


def r(expression: str, digits: int, name: str) -> str:
    """Rounded; adding zero turns a rounded -0.0 into 0.0."""
    return f"round({expression}, {digits}) + 0.0 as {name}"


def share(condition: str) -> str:
    return f"avg(case when {condition} then 1.0::double else 0.0::double end) * 100.0"


METRICS = {
    "mean_glucose": "avg(value)",
    "min_glucose": "min(value)",
    "max_glucose": "max(value)",
    "coefficient_of_variation_pct": "case when avg(value) = 0 then 0.0 else 100.0::double * stddev_pop(value) / avg(value) end",
    "time_in_range_pct": share("value >= 70 and value <= 180"),
    "time_below_range_pct": share("value < 70"),
    "time_above_range_pct": share("value > 180"),
    "time_very_low_pct": share("value < 54"),
    "time_very_high_pct": share("value > 250"),
}


def metric_list(digits: int) -> str:
    return ", ".join(r(expression, digits, name) for name, expression in METRICS.items())


SERIES_WINDOW = "partition by user_id order by epoch_us(ts)"


def trailing(expression: str, minutes: int, key: str, closed: str = "both") -> str:
    span = minutes * 60_000_000 - (0 if closed == "both" else 1)
    return (
        f"{expression} over (partition by {key} order by epoch_us(ts) "
        f"range between {span} preceding and current row)"
    )


# Gaps, cadence and steps of a series table with columns s (series), ts and us.
PACE = """
  gaps as (select s, us - lag(us) over (partition by s order by us) as gap from stamps),
  pace as (select s, median(gap) / 60000000.0::double as cadence from gaps
           where gap > 0 and gap <= 1800000000 group by s)"""


def step(span: int) -> str:
    return f"greatest(1, round_even({span}.0::double / cadence, 0)::bigint)"


FIRST_WINDOWS = """
with people as (
  select c_custkey as user_id,
         case when c_acctbal is null then 'unknown' when c_acctbal / 1000 < 5.7::double then 'healthy'
              when c_acctbal / 1000 <= 6.4::double then 'prediabetes' else 'type2_diabetes' end as diagnosis
  from customer),
rows_ as (select event_id, user_id, diagnosis, ts, min(ts) over (partition by diagnosis, user_id) as start_
          from events join people using (user_id)),
early as (select * from rows_ where ts < start_ + interval 240 hour),
sizes as (select diagnosis, user_id, count(*) as rows, min(ts) as "start", max(ts) as "end"
          from early group by all having count(*) >= 20),
best as (select * from sizes qualify row_number() over (partition by diagnosis order by user_id) = 1)
"""

DIAGNOSED = f"""
with raw as (select event_type, case when k >= 3 then ts end as ts, value as a,
                    case when k >= 50 then value end as b from {EK}),
base as (select event_type, count(*) as raw_rows, count(ts) as parsed_rows from raw group by 1),
sa as (select distinct event_type, ts from raw where ts is not null and a is not null),
sb as (select distinct event_type, ts from raw where ts is not null and b is not null),
ga as (select event_type, median(gap) / 60000000.0::double as g from
        (select event_type, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts) as gap from sa)
        where gap is not null group by 1),
gb as (select event_type, median(gap) / 60000000.0::double as g from
        (select event_type, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts) as gap from sb)
        where gap is not null group by 1),
pa as (select p.event_type, p.ts, b.ts as bts, f.ts as fts
       from (select *, ts + interval 30 minute as w from sa) p
       asof left join sa b on p.event_type = b.event_type and p.w >= b.ts
       asof left join sa f on p.event_type = f.event_type and p.w <= f.ts),
pb as (select p.event_type, p.ts, b.ts as bts, f.ts as fts
       from (select *, ts + interval 30 minute as w from sb) p
       asof left join sb b on p.event_type = b.event_type and p.w >= b.ts
       asof left join sb f on p.event_type = f.event_type and p.w <= f.ts),
ha as (select event_type, count(*) as n, count(*) filter (where (case
          when bts is not null and (fts is null or (ts + interval 30 minute) - bts <= fts - (ts + interval 30 minute))
          then case when (ts + interval 30 minute) - bts <= interval 450 second then bts end
          else case when fts - (ts + interval 30 minute) <= interval 450 second then fts end end) > ts) as h
       from pa group by 1),
hb as (select event_type, count(*) as n, count(*) filter (where (case
          when bts is not null and (fts is null or (ts + interval 30 minute) - bts <= fts - (ts + interval 30 minute))
          then case when (ts + interval 30 minute) - bts <= interval 1200 second then bts end
          else case when fts - (ts + interval 30 minute) <= interval 1200 second then fts end end) > ts) as h
       from pb group by 1),
report as (select event_type, raw_rows, parsed_rows,
       coalesce(ha.n, 0) as a_rows, coalesce(ha.h, 0) as a_future_pairs, ga.g as a_median_gap_minutes,
       coalesce(hb.n, 0) as b_rows, coalesce(hb.h, 0) as b_future_pairs, gb.g as b_median_gap_minutes
from base left join ha using (event_type) left join ga using (event_type)
          left join hb using (event_type) left join gb using (event_type))
"""

FORECAST = f"""
with ahead as (select * from (select *, lead(value) over ({SERIES_WINDOW}) as target from events)
               where target is not null),
forecast as (select *, {trailing('avg(value)', 4320, 'user_id', 'right')} as prediction from ahead)
"""


def errors(prediction: str = "prediction") -> str:
    return (
        f"avg(abs({prediction} - target)) as mae_mg_dl, "
        f"sqrt(avg(({prediction} - target) * ({prediction} - target))) as rmse_mg_dl, "
        "avg(abs(target - value)) as persistence_mae_mg_dl, count(*) as test_samples, "
        "count(distinct user_id) as test_participants"
    )


SAMPLES = "(select event_id, user_id, ts from events where event_type <> 'purchase')"
HAPPENED = f"(select user_id, ts, value, k from {EK} where event_type = 'purchase')"
AGE = "(epoch_us(s.ts) - epoch_us(e.ts)) / 60000000.0::double"

RAW = f"""
raw as (select event_type as participant_id, ts, event_id,
       case when event_type <> 'view' and k >= 5 then value + 1.5 end as dexcom,
       case when k >= 2 then value end as libre, k as heart_rate,
       case when k < 70 then value / 10 end as mets, value / 20 as activity_calories,
       case when k >= 90 then value / 4 end as carbs, case when k >= 90 then k end as protein,
       case when k >= 90 and value > 100 then value / 5 end as fat,
       case when k >= 90 then k / 10 end as fiber from {EK})"""

FEATURE_TABLE = f"""
with {RAW},
chosen as (select *, case when count(dexcom) over (partition by participant_id) > 0 then dexcom else libre end
           as glucose_mg_dl from raw),
ev as (select *, epoch_us(ts) as us,
         {', '.join(f"coalesce(sum({n}) over w120, 0.0) as {n}_last_120m" for n in ['carbs', 'protein', 'fat', 'fiber'])}
       from chosen
       window w120 as (partition by participant_id order by epoch_us(ts) range between 7200000000 preceding and current row)),
sel as (select *, participant_id as s from ev where glucose_mg_dl is not null),
stamps as (select s, us from sel), {PACE},
sizes as (select s, count(*) as n from sel group by s),
rolled as (select sel.*, cadence,
         avg(heart_rate) over w30 as heart_rate_mean_30m, avg(mets) over w60 as mets_mean_60m,
         sum(activity_calories) over w60 as activity_calories_60m,
         lag(glucose_mg_dl, {step(15)}) over o as glucose_lag_15m, lag(us, {step(15)}) over o as u15,
         lag(glucose_mg_dl, {step(30)}) over o as glucose_lag_30m, lag(us, {step(30)}) over o as u30,
         lead(glucose_mg_dl, {step(30)}) over o as target_30m, lead(us, {step(30)}) over o as ut,
         lead(ts, {step(30)}) over o as target_timestamp
       from sel join pace using (s) join sizes using (s) where n >= 60
       window o as (partition by s order by us),
              w30 as (partition by s order by us range between 1799999999 preceding and current row),
              w60 as (partition by s order by us range between 3599999999 preceding and current row)),
static_ as (select row_number() over (order by c_mktsegment) as p, count(*)::double as age,
         avg(c_acctbal) / 200 as bmi, avg(c_acctbal) / 700 as hba1c, max(c_acctbal) as fasting_glucose,
         null::double as fasting_insulin from customer group by c_mktsegment),
ids as (select participant_id, row_number() over (order by participant_id) as p
        from (select distinct participant_id from raw)),
joined as (select *, extract(hour from ts) + extract(minute from ts) / 60.0::double as h
           from rolled join ids using (participant_id) left join static_ using (p)
           where abs((us - u15) / 60000000.0::double - 15) <= greatest(2.0::double, 2 * cadence)
             and abs((us - u30) / 60000000.0::double - 30) <= greatest(2.0::double, 2 * cadence)
             and abs((ut - us) / 60000000.0::double - 30) <= greatest(2.0::double, 2 * cadence))
select participant_id, ts as timestamp, {r('glucose_mg_dl', 6, 'glucose_mg_dl')}, {r('h', 6, 'hour')},
  {r('sin(2 * pi() * h / 24)', 6, 'sin_time')}, {r('cos(2 * pi() * h / 24)', 6, 'cos_time')},
  {', '.join(r(n, 6, n) for n in ['carbs_last_120m', 'protein_last_120m', 'fat_last_120m', 'fiber_last_120m',
     'heart_rate', 'mets', 'activity_calories', 'heart_rate_mean_30m', 'mets_mean_60m', 'activity_calories_60m',
     'age', 'bmi', 'hba1c', 'fasting_glucose', 'fasting_insulin'])},
  case when hba1c is null then 'unknown' when hba1c < 5.7::double then 'healthy'
       when hba1c <= 6.4::double then 'prediabetes' else 'type2_diabetes' end as diagnosis,
  {r('glucose_lag_15m', 6, 'glucose_lag_15m')}, {r('glucose_lag_30m', 6, 'glucose_lag_30m')},
  {r('glucose_mg_dl - glucose_lag_15m', 6, 'glucose_delta_15m')}, {r('target_30m', 6, 'target_30m')}, target_timestamp
from joined
"""

RESOURCE = """'{"resourceType":"Observation","status":"final","category":[{"coding":[{"system":"http://terminology.hl7.org/CodeSystem/observation-category","code":"laboratory","display":"Laboratory"}]}],"code":{"coding":[{"system":"http://loinc.org","code":"15074-8","display":"Glucose [Moles/volume] in Blood"}],"text":"Simulated glucose"},"subject":{"reference":"Patient/' || user_id || '"},"effectiveDateTime":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '","valueQuantity":{"value":' || round_even(value, 1)::double::varchar || ',"unit":"mg/dL","system":"http://unitsofmeasure.org","code":"mg/dL"},"note":[{"text":"Synthetic observation; not a clinical measurement."}]}'"""

# The wide table per user for the models.
USER_FEATURES = ["glucose_mg_dl", "lag_1", "lag_2", "heart_rate", "mean_3d", "sin_time", "cos_time"]
USERS = f"""with hours as (select *, hour(ts) + minute(ts) / 60.0::double as h from {EK}),
shifted as (select user_id::varchar as participant_id, ts as timestamp, event_type, value as glucose_mg_dl,
    lag(value, 1) over w as lag_1, lag(value, 2) over w as lag_2, case when k >= 10 then k end as heart_rate,
    {trailing('avg(value)', 4320, 'user_id', 'right')} as mean_3d,
    sin(2 * pi() * h / 24) as sin_time, cos(2 * pi() * h / 24) as cos_time, lead(value, 1) over w as target_30m
  from hours window w as (partition by user_id order by ts)),
users as (select * from shifted where target_30m is not null)"""
HELD_OUT = f"""{USERS},
ids as (select participant_id, md5(concat_ws(':', participant_id, '42')) as h from (select distinct participant_id from users)),
marked as (select participant_id, row_number() over (order by h) <= ceil(0.2 * count(*) over ()) as is_test from ids),
split as (select * from users join marked using (participant_id))"""


def _each(make, joined: str = ", ") -> str:
    return joined.join(make(i, n) for i, n in enumerate(USER_FEATURES))


def _ridge() -> str:
    """Ridge regression per user in closed form: the standardised system is solved by elimination, one
    column per recursion step. It is positive definite, so no rows are swapped."""
    size = len(USER_FEATURES)
    cells = "[" + ", ".join(
        "[" + ", ".join(
            f"(avg(z{i} * z{j}) - avg(z{i}) * avg(z{j})) / (stddev_pop(z{i}) * stddev_pop(z{j}))"
            + (" + 1.0::double / count(*)" if i == j else "")
            for j in range(size)
        ) + f", (avg(z{i} * y) - avg(z{i}) * avg(y)) / stddev_pop(z{i})]"
        for i in range(size)
    ) + "]"
    swept = "[" + ", ".join(
        "[" + ", ".join(
            f"case when step = {i} then m[step][{j}] / m[step][step] else m[{i}][{j}] - m[{i}][step] * m[step][{j}] / m[step][step] end"
            for j in range(1, size + 2)
        ) + "]"
        for i in range(1, size + 1)
    ) + "]"
    weights = "[" + ", ".join(f"m[{i + 1}][{size + 1}] / s{i}" for i in range(size)) + "]"
    return f"""{USERS.replace('with ', 'with recursive ', 1)},
numbered as (select *, row_number() over (partition by participant_id order by timestamp) as rn,
    count(*) over (partition by participant_id) as c from users),
split as (select *, rn > least(greatest(floor(c * 0.7::double), 30), c - 20) as is_test from numbered where c >= 60),
middle as (select participant_id, {_each(lambda i, n: f"median({n}) as c{i}")} from split where not is_test group by 1),
centred as (select split.*, target_30m - glucose_mg_dl as y, {_each(lambda i, n: f"coalesce({n} - c{i}, 0) as z{i}")}
  from split join middle using (participant_id)),
systems as (select participant_id, {cells} as m, avg(y) as my, {_each(lambda i, n: f"avg(z{i}) as a{i}, stddev_pop(z{i}) as s{i}")}
  from centred where not is_test group by 1),
solving as (select participant_id, 1 as step, m from systems
  union all select participant_id, step + 1, {swept} from solving where step <= {size}),
solved as (select participant_id, my, {_each(lambda i, n: f"a{i}")}, {weights} as b
  from (select participant_id, m from solving where step = {size + 1}) as done join (select * exclude (m) from systems) as known using (participant_id)),
predicted as (select centred.*, glucose_mg_dl + my + {_each(lambda i, n: f"b[{i + 1}] * (z{i} - a{i})", " + ")} as prediction
  from centred join solved using (participant_id) where is_test),
errors as (select participant_id, avg(abs(prediction - target_30m)) as mae, sqrt(avg(power(prediction - target_30m, 2))) as rmse,
    avg(abs(target_30m - glucose_mg_dl)) as persistence, count(*) as test_samples, any_value(c) - count(*) as train_samples
  from predicted group by 1)
"""


RIDGE = _ridge()


def _boosted(split: str, model: str, rounds: int, leaves: int, least: int, bins: int, step: float, l2: float) -> str:
    """Boosted trees by their definition: the leaf of greatest gain is split, one leaf after the other, over and over.

    ``predicted`` holds the test rows. ``model`` tells the rows of one model from another's.
    """
    size = len(USER_FEATURES)
    ctes = [f"""{split},
rows_ as materialized (select *, {model} as m, row_number() over (order by participant_id, timestamp) as id from split),
middle as (select m, {_each(lambda i, n: f"median({n}) as c{i}")} from rows_ where not is_test group by m),
filled as materialized (select rows_.*, {_each(lambda i, n: f"coalesce({n}, c{i}, 0.0) as x{i}")} from rows_ join middle using (m)),
cells as materialized ({" union all ".join(f"select id, m, is_test, {i} as f, x{i} as x from filled" for i in range(size))}),
ranked as (select m, f, x, row_number() over (partition by m, f order by x) as rn, count(*) over (partition by m, f) as c
  from cells where not is_test),
edges as materialized (select distinct m, f, x as edge from ranked, range(1, {bins}) as t(i) where rn = ceil(i::double / {bins}.0::double * c)),
binned as materialized (select id, cells.m, cells.f, count(edge) as b from cells left join edges
  on edges.m = cells.m and edges.f = cells.f and edge < x group by all),
units as (select m, power(2.0::double, 28 - ceil(log2(max(abs(target_30m))))) as sc from rows_ where not is_test group by m),
state0 as materialized (select id, m, is_test, target_30m as y, sc, (select sum(round_even(o.target_30m * units.sc, 0)) / count(*) / units.sc
  from rows_ as o where o.m = rows_.m and not o.is_test) as now from rows_ join units using (m))"""]
    for t in range(rounds):
        ctes.append(f"n{t}_0 as materialized (select id, m, is_test, sc, round_even((y - now) * sc, 0) as g, 0 as node from state{t})")
        for s in range(leaves - 1):
            ctes.append(f"""h{t}_{s} as (select r.m, node, f, b, sum(g) as g, count(*) as k from n{t}_{s} as r join binned using (id)
  where not is_test group by all),
c{t}_{s} as (select m, node, f, b, sum(g) over w as gl, sum(k) over w as kl, sum(g) over p as gt, sum(k) over p as kt
  from h{t}_{s} window w as (partition by m, node, f order by b), p as (partition by m, node, f)),
v{t}_{s} as (select *, gl * gl / (kl + {l2}::double) + (gt - gl) * (gt - gl) / (kt - kl + {l2}::double) - gt * gt / (kt + {l2}::double) as gain
  from c{t}_{s} where kl >= {least} and kt - kl >= {least}),
s{t}_{s} as materialized (select m, node, f, b from v{t}_{s} where gain > 0
  qualify row_number() over (partition by m order by gain desc, node, f, b) = 1),
n{t}_{s + 1} as materialized (select r.id, r.m, is_test, sc, g, case when x.f is null then r.node when z.b > x.b then {2 * s + 2}
  else {2 * s + 1} end as node from n{t}_{s} as r left join s{t}_{s} as x on x.m = r.m and x.node = r.node
  left join binned as z on z.id = r.id and z.f = x.f)""")
        last = f"n{t}_{leaves - 1}"
        ctes.append(f"""l{t} as (select m, node, {step}::double * (sum(g) / (count(*) + {l2}::double)) * (1.0::double / any_value(sc)) as value
  from {last} where not is_test group by m, node),
state{t + 1} as materialized (select o.id, o.m, o.is_test, o.y, o.sc, o.now + l{t}.value as now
  from state{t} as o join {last} as r using (id) join l{t} on l{t}.m = r.m and l{t}.node = r.node)""")
    ctes.append(f"predicted as (select rows_.*, now as prediction from rows_ join state{rounds} using (id) where rows_.is_test)\n")
    return ",\n".join(ctes)


#: Both sides round what is not exact, so that equal values stay equal.
ROUNDED = USERS.replace("users as (select * from", "users as (select * replace (round(mean_3d, 6) as mean_3d, "
    "round(sin_time, 6) as sin_time, round(cos_time, 6) as cos_time) from")  # fmt: skip
LATER = f"""{ROUNDED},
numbered as (select *, row_number() over (partition by participant_id order by timestamp) as rn,
    count(*) over (partition by participant_id) as c from users),
split as (select *, rn > least(greatest(floor(c * 0.7::double), 30), c - 20) as is_test from numbered where c >= 60)"""
EACH_BOOSTED = _boosted(LATER, "participant_id", rounds=4, leaves=4, least=5, bins=16, step=0.3, l2=0.6)
ALL_BOOSTED = _boosted(HELD_OUT.replace(USERS, ROUNDED), "0", rounds=5, leaves=6, least=20, bins=64, step=0.2, l2=0.6)

INGESTED = f"""
with numbered as (select *, list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) as n, trunc(k) as i
  from {EK})
select event_id, lpad(n::varchar, 3, '0') as participant_id, date_trunc('second', ts) as timestamp, value as dexcom,
  case when n % 2 = 1 then i end as libre, i as heart_rate, i as mets, null::double as activity_calories,
  case when k >= 90 then i end as carbs,
  k >= 90 or (n % 2 = 0 and k < 5) as is_event
from numbered"""

ORACLE = {
    "numeric_clean": f"select event_id, {K} as number from events",
    "numeric_clean_mixed": r"""
        select kind, raw, try_cast(regexp_replace(raw, '[^0-9eE+\-.]', '', 'g') as double) as number from (
          select 'part' as kind, p_brand as raw from part
          union all select 'orders', '<' || cast(o_totalprice as decimal(18,2))::varchar || ' USD' from orders
          union all select 'customer', c_name from customer)""",
    "nullable_numeric": f"select event_id, case when k >= 80 or k < 20 then null else k end as number from {EK}",
    "parse_timestamps": """
        select event_id, case event_type when 'error' then null when 'signup' then ts
          when 'view' then date_trunc('second', ts) else date_trunc('minute', ts) end as parsed from events""",
    "pad_id": """select event_id, case when length(user_id::varchar) < 3 then lpad(user_id::varchar, 3, '0')
        else user_id::varchar end as series_id from events""",
    "time_cyclical": f"""
        select event_id, {r('h', 8, 'hour')}, {r('sin(2 * pi() * h / 24)', 8, 'sin_time')},
          {r('cos(2 * pi() * h / 24)', 8, 'cos_time')}
        from (select event_id, extract(hour from ts) + extract(minute from ts) / 60.0::double as h from events)""",
    "event_filter": f"select event_id, event_type from {EK} where event_type = 'purchase' or k >= 90",
    "band_classify": """
        select c_custkey, case when c_mktsegment = 'MACHINERY' or c_acctbal is null then 'unknown'
          when c_acctbal / 1000 < 5.7::double then 'healthy' when c_acctbal / 1000 <= 6.4::double then 'prediabetes'
          else 'type2_diabetes' end as diagnosis from customer""",
    "prediction_band": f"""
        select event_id, {r('greatest(40.0::double, value - s)', 8, 'lower')},
          {r('least(400.0::double, value + s)', 8, 'upper')}
        from (select *, greatest(5.0::double, 1.64::double * k / 4) as s from {EK})""",
    "clamp_round": """select event_id, round_even(least(400.0::double, greatest(45.0::double, value * 4 / 3)), 2) as value
        from events""",
    "label_format": """
        select o_orderkey, array_to_string(list_transform(regexp_extract_all(o_orderpriority, '[A-Za-z]+|[^A-Za-z]+'),
          lambda w: upper(w[1:1]) || lower(w[2:])), '') as label from orders""",
    "valid_rows": f"""
        select event_id, case when user_id < 10 then '00' when user_id < 100 then '0' else '' end || user_id as user_id,
          ts, value from {EK}
        where not (event_type = 'view' and k >= 90) and not (event_type = 'error' and k >= 90)
          and not (event_type = 'click' and k < 5) and not (event_type = 'signup' and k < 5)""",
    "drop_incomplete": f"select event_id, k, value from {EK} where k >= 10 and value < 200",
    "bounds_validate": """
        select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
          concat_ws('; ', case when l_quantity < 2 or l_quantity > 40 then 'l_quantity outside [2, 40]' end,
            case when l_discount < 0 or l_discount >= 0.08::double then 'l_discount outside [0, 0.08)' end,
            case when l_tax < 0.01::double or l_tax > 0.06::double then 'l_tax outside [0.01, 0.06]' end) as reasons,
          not (l_quantity < 2 or l_quantity > 40 or l_discount < 0 or l_discount >= 0.08::double
               or l_tax < 0.01::double or l_tax > 0.06::double) as is_valid
        from lineitem""",
    "sort_nested_events": """
        select l_orderkey, l_linenumber, l_partkey, array_to_string(list_transform(list_sort([
            {'h': (l_quantity % 24)::double, 'i': 0, 'l': 'l_quantity'},
            {'h': (l_partkey % 24)::double, 'i': 1, 'l': 'l_partkey'},
            {'h': (l_suppkey % 24)::double, 'i': 2, 'l': 'l_suppkey'}]), lambda e: e.l), ',') as labels
        from lineitem""",
    "range_metrics": f"select user_id, {metric_list(8)} from events group by user_id",
    "range_metrics_by_type": f"select event_type, {metric_list(7)} from events group by event_type",
    "range_bands": f"""
        select user_id, {r('vl', 8, 'very_low_pct')}, {r('greatest(0.0::double, tb - vl)', 8, 'low_pct')},
          {r('tir', 8, 'in_range_pct')}, {r('greatest(0.0::double, ta - vh)', 8, 'high_pct')}, {r('vh', 8, 'very_high_pct')}
        from (select user_id, {METRICS['time_very_low_pct']} as vl, {METRICS['time_below_range_pct']} as tb,
          {METRICS['time_in_range_pct']} as tir, {METRICS['time_above_range_pct']} as ta,
          {METRICS['time_very_high_pct']} as vh from events group by user_id)""",
    "distinct_series": "select distinct user_id from events order by 1",
    "series_header": """
        select user_id, arg_min(event_type, ts) as event_type, arg_min(value, ts) as value,
          min(ts) as "start", max(ts) as "end",
          upper(arg_min(event_type, ts)[1:1]) || arg_min(event_type, ts)[2:] as event_type_label
        from events group by user_id""",
    "series_filter": "select event_id, user_id, ts, value from events where user_id = 7",
    "min_size_gate": """select event_id, user_id from events
        where user_id in (select user_id from events group by 1 having count(*) >= 66)""",
    "signal_fallback": """
        select user_id, case when d > 0 then 'dexcom' else 'libre' end as source, d as dexcom, l as libre
        from (select user_id, count(*) filter (where event_type = 'error' and value > 120) as d,
                count(*) filter (where event_type <> 'error') as l from events group by 1)
        where d > 0 or l > 0""",
    "signal_label": """
        select case when count(distinct src) = 1 then min(src) else 'mixed' end as glucose_source, count(*) as series
        from (select user_id, case when count(*) filter (where event_type = 'error' and value > 120) > 0 then 'dexcom'
                else 'libre' end as src from events group by 1
              having count(*) filter (where event_type <> 'error' or value > 120) > 0)""",
    "paired_compare": f"""
        with daily as (select user_id, ts::date as slot, event_type, avg(value) as value from events group by all),
        pairs as (select user_id, c.value as c, f.value as f
                  from (select * from daily where event_type = 'click') c
                  join (select * from daily where event_type = 'view') f using (user_id, slot)),
        both_ as (select user_id, count(*) as slots, avg(c) as cm, max(c) as cp, {share('c >= 70 and c <= 180')} as cr,
                    avg(f) as fm, max(f) as fp, {share('f >= 70 and f <= 180')} as fr from pairs group by 1)
        select user_id, slots, {r('cm', 6, 'current_mean')}, {r('cp', 6, 'current_peak')},
          {r('cr', 6, 'current_in_range_pct')}, {r('fm', 6, 'reference_mean')}, {r('fp', 6, 'reference_peak')},
          {r('fr', 6, 'reference_in_range_pct')}, {r('cm - fm', 6, 'delta_mean')}, {r('cp - fp', 6, 'delta_peak')},
          {r('cr - fr', 6, 'delta_in_range_pct')} from both_""",
    "gap_minutes": f"""
        select event_id, g as gap_us, g / 60000000.0::double as gap_minutes
        from (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over ({SERIES_WINDOW}) as g from events)""",
    "cadence_median": f"""
        with stamps as (select event_type as s, epoch_us(ts) as us from events), {PACE}
        select s as event_type, cadence as cadence_minutes from pace""",
    "dedup_first": """
        select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
        qualify row_number() over (partition by l_suppkey, l_shipdate
          order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) = 1""",
    "event_sum_window": f"""
        select event_id, round(coalesce({trailing("sum(case when event_type = 'purchase' then value end)", 4320, 'user_id')},
          0.0::double), 4) + 0.0 as event_sum from events""",
    "event_sum_product": f"""
        select event_id, round(coalesce({trailing("sum(case when event_type = 'purchase' then value * k end)", 4320, 'user_id')},
          0.0::double), 4) + 0.0 as event_sum from {EK}""",
    "rolling_mean_time": f"""
        select event_id, {r(trailing('avg(value)', 30, 'event_type', 'right'), 8, 'mean_30m')},
          {r(trailing('avg(case when k >= 50 then value end)', 60, 'event_type', 'right'), 8, 'masked_mean_60m')}
        from {EK}""",
    "rolling_sum_time": f"""
        select event_id, {r(trailing('sum(case when k >= 50 then value end)', 60, 'event_type', 'right'), 4, 'sum_60m')}
        from {EK}""",
    "lag_lead_timed": f"""
        with base as (select event_id, event_type as s, ts, epoch_us(ts) as us, value from events),
        stamps as (select s, us from base), {PACE},
        shifted as (select base.*, cadence, lag(value, {step(15)}) over o as lag_15m, lag(us, {step(15)}) over o as u15,
            lag(value, {step(30)}) over o as lag_30m, lag(us, {step(30)}) over o as u30,
            lead(value, {step(30)}) over o as target_30m, lead(us, {step(30)}) over o as ut,
            lead(ts, {step(30)}) over o as target_ts
          from base join pace using (s) window o as (partition by s order by us))
        select event_id, lag_15m, lag_30m, {r('value - lag_15m', 4, 'delta_15m')}, target_30m, target_ts from shifted
        where abs((us - u15) / 60000000.0::double - 15) <= greatest(2.0::double, 2 * cadence)
          and abs((us - u30) / 60000000.0::double - 30) <= greatest(2.0::double, 2 * cadence)
          and abs((ut - us) / 60000000.0::double - 30) <= greatest(2.0::double, 2 * cadence)""",
    "lag_within_day": """
        select event_id, lag(value, 3) over o as lag_3, lag(value, 6) over o as lag_6, lead(value, 6) over o as lead_6
        from events window o as (partition by event_type, ts::date order by ts)""",
    "static_join": """
        select event_id, user_id, o_orderkey, o_totalprice, o_orderpriority from events left join (
          select o_custkey as user_id, o_orderkey, o_totalprice, o_orderpriority from orders
          qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1) using (user_id)""",
    "static_id_key": """select c_custkey, lpad(substr(c_custkey::varchar, 1, 3), 3, '0') as series_id from customer""",
    "positional_join": """
        select user_id, s_suppkey, s_name, s_acctbal
        from (select user_id, row_number() over (order by user_id) as p from (select distinct user_id from events))
        left join (select s_suppkey, s_name, s_acctbal, row_number() over (order by s_suppkey) as p from supplier) using (p)""",
    "asof_nearest": """
        with wanted as (select event_id, event_type, ts, ts + interval 30 minute as w from events),
        near as (select q.*, b.ts as bts, f.ts as fts from wanted q
          asof left join events b on q.event_type = b.event_type and q.w >= b.ts
          asof left join events f on q.event_type = f.event_type and q.w <= f.ts),
        m as (select *, case when bts is not null and (fts is null or w - bts <= fts - w)
            then case when w - bts <= interval 450 second then bts end
            else case when fts - w <= interval 450 second then fts end end as matched_ts from near)
        select event_id, matched_ts, coalesce(matched_ts > ts, false) as hit from m""",
    "asof_pair": """
        with l as (select event_id, user_id, ts from events where event_type = 'purchase'),
        v as (select user_id, ts, value from events where event_type = 'view'),
        near as (select l.*, b.ts as bts, b.value as bv, f.ts as fts, f.value as fv from l
          asof left join v b on l.user_id = b.user_id and l.ts >= b.ts
          asof left join v f on l.user_id = f.user_id and l.ts <= f.ts),
        pick as (select *, bts is not null and (fts is null or ts - bts <= fts - ts) as back from near)
        select event_id,
          case when back then case when ts - bts <= interval 24 hour then bts end
               else case when fts - ts <= interval 24 hour then fts end end as matched_seen,
          case when back then case when ts - bts <= interval 24 hour then bv end
               else case when fts - ts <= interval 24 hour then fv end end as matched_value
        from pick""",
    "event_sum_join": f"""
        select s.event_id, round(coalesce(sum(e.value), 0.0::double), 4) + 0.0 as event_sum from {SAMPLES} s
        left join {HAPPENED} e on s.user_id = e.user_id and e.ts <= s.ts and s.ts <= e.ts + interval 3 day
        group by s.event_id""",
    "kernel_gamma": f"""
        select s.event_id, round(coalesce(sum(e.value * ({AGE} / 720) * exp(1 - {AGE} / 720)), 0.0::double), 6) + 0.0 as response
        from {SAMPLES} s
        left join {HAPPENED} e on s.user_id = e.user_id and e.ts <= s.ts and s.ts <= e.ts + interval 4 day
        group by s.event_id""",
    "kernel_onset_decay": f"""
        select s.event_id, round(coalesce(sum(e.value / 100 * least(e.k * 10 / 450, 1.6::double) * (1 - exp(-{AGE} / 240))
            * exp(-greatest({AGE} - greatest(e.k * 10, 1), 0) / 1440)), 0.0::double), 6) + 0.0 as response
        from {SAMPLES} s
        left join {HAPPENED} e on s.user_id = e.user_id and e.ts <= s.ts and s.ts <= e.ts + interval 4 day
        group by s.event_id""",
    "union_sources": """
        select user_id as series_id, ts, value, null::double as amount from events
        union all select o_custkey, o_orderdate, null, o_totalprice from orders""",
    "stride_downsample": """
        select event_id, user_id, ts, value from (select *, row_number() over (partition by user_id order by ts) as n,
            count(*) over (partition by user_id) as c from events) where (n - 1) % greatest(1, c // 20) = 0""",
    "stride_fixed": """
        select event_id, event_type, ts from events
        qualify (row_number() over (partition by event_type order by ts) - 1) % 3 = 0""",
    "tail_n": """
        select event_id, user_id, ts, value from events
        qualify row_number() over (partition by user_id order by ts desc) <= 48""",
    "tail_many": """
        select event_id, event_type, ts, value from events
        qualify row_number() over (partition by event_type order by ts desc) <= 1500""",
    "subset_first_window": FIRST_WINDOWS
    + "select event_id, user_id, diagnosis, ts from early semi join best using (diagnosis, user_id)",
    "subset_metadata": FIRST_WINDOWS + 'select diagnosis, user_id, rows, "start", "end" from best',
    "sensor_diagnostics": DIAGNOSED + "select * from report",
    "diagnostics_totals": DIAGNOSED
    + """select event_type, sum(raw_rows)::bigint as raw_rows, sum(parsed_rows)::bigint as parsed_rows,
        sum(a_rows)::bigint as a_rows, sum(a_future_pairs)::bigint as a_future_pairs, sum(b_rows)::bigint as b_rows,
        sum(b_future_pairs)::bigint as b_future_pairs, grouping(event_type) = 1 as is_total
        from report group by rollup (event_type)""",
    "group_split": """
        with ids as (select user_id, md5(concat_ws(':', user_id::varchar, '42')) as h from (select distinct user_id from events)),
        marked as (select user_id, row_number() over (order by h) <= ceil(0.2 * count(*) over ()) as is_test from ids)
        select event_id, user_id, is_test from events join marked using (user_id)""",
    "chrono_split": """
        select event_id, n > least(greatest(floor(c * 0.7::double), 30), c - 20) as is_test
        from (select *, row_number() over (partition by user_id order by ts) as n,
                count(*) over (partition by user_id) as c from events) where c >= 60""",
    "day_split": """
        select event_id, dayofyear(ts) as day,
          dayofyear(ts) > (select greatest(1, floor(max(dayofyear(ts)) * 0.78::double)) from events) as is_test from events""",
    "median_impute": f"""
        with rows_ as (select event_id, dayofyear(ts) as day, case when k < 80 then value end as level,
            case when value < 60 then k end as rate from {EK}),
        train as (select * from rows_ where day <= (select greatest(1, floor(max(day) * 0.78::double)) from rows_)),
        m as (select median(level) as ml, median(rate) as mr from train)
        select event_id, {r('coalesce(level, ml)', 8, 'level')}, {r('coalesce(rate, mr)', 8, 'rate')},
          null::double as unseen from rows_ cross join m""",
    "persistence_eval": FORECAST
    + f"""select event_type, {r('mae_mg_dl', 6, 'mae_mg_dl')}, {r('rmse_mg_dl', 6, 'rmse_mg_dl')},
        {r('persistence_mae_mg_dl', 6, 'persistence_mae_mg_dl')}, test_samples, test_participants
        from (select event_type, {errors()} from forecast group by 1)""",
    "benchmark_summary": FORECAST
    + f""", per_user as (select user_id, {errors()} from forecast group by 1),
        gained as (select *, persistence_mae_mg_dl - mae_mg_dl as gain from per_user)
        select count(*) as participants,
          {', '.join(r(f'avg({c})', 6, f'mean_{n}') + ', ' + r(f'median({c})', 6, f'median_{n}') for n, c in
             [('mae_mg_dl', 'mae_mg_dl'), ('rmse_mg_dl', 'rmse_mg_dl'), ('persistence_mae_mg_dl', 'persistence_mae_mg_dl'),
              ('mae_improvement_vs_persistence', 'gain')])},
          count(*) filter (where gain > 0) as participants_beating_persistence,
          count(*) filter (where gain = 0) as participants_tying_persistence
        from gained""",
    "rank_models": FORECAST
    + f"""select model_name, {r('mae_mg_dl', 6, 'mae_mg_dl')}, {r('rmse_mg_dl', 6, 'rmse_mg_dl')} from (
          select 'trailing_mean' as model_name, {errors()} from forecast
          union all select 'persistence', {errors('value')} from forecast) order by mae_mg_dl""",
    "feature_table": FEATURE_TABLE,
    "saved_table": FEATURE_TABLE,
    "saved_summary": USERS
    + f""" select participant_id, n as rows, p as participants, 'dexcom' as glucose_source, 30::bigint as horizon_minutes,
          {len(USER_FEATURES)} as features, 'test' as license
        from (select distinct participant_id from users), (select count(*) as n, count(distinct participant_id) as p from users)""",
    "fhir_observation": f"select event_id, {RESOURCE} as resource from events",
    "fhir_bundle": f"""
        with placed as (select user_id, {RESOURCE} as resource, row_number() over (partition by user_id order by ts) as n,
            count(*) over (partition by user_id) as c from events)
        select user_id, (n - 1) // 50 as page, count(*) as entries,
          '{{"resourceType":"Bundle","type":"collection","total":' || any_value(c) || ',"link":[{{"relation":"self","url":"page=' ||
          (n - 1) // 50 || '"}}' || case when ((n - 1) // 50 + 1) * 50 < any_value(c)
            then ',{{"relation":"next","url":"page=' || (n - 1) // 50 + 1 || '"}}' else '' end || '],"entry":[' ||
          string_agg('{{"resource":' || resource || '}}', ',' order by n) ||
          '],"meta":{{"tag":[{{"display":"Synthetic educational data"}}]}}}}' as bundle
        from placed group by user_id, (n - 1) // 50""",
    "rf_predict": HELD_OUT
    + " select participant_id, timestamp, glucose_mg_dl, target_30m, true as plausible from split where is_test",
    "compare_models": HELD_OUT
    + """ select model_name, 'participant_holdout' as split_strategy, true as rmse_not_below_mae,
          round_even(avg(abs(target_30m - glucose_mg_dl)) filter (where is_test), 2) as persistence_mae_mg_dl,
          count(*) filter (where not is_test) as train_samples, count(*) filter (where is_test) as test_samples,
          count(distinct participant_id) filter (where not is_test) as train_participants,
          count(distinct participant_id) filter (where is_test) as test_participants
        from split, (values ('hgb'), ('random_forest')) as models(model_name) group by model_name""",
    "per_series_eval": RIDGE
    + f"""select participant_id, 'ridge' as model_name, 'within_patient_chronological' as split_strategy,
          {r('mae', 6, 'mae_mg_dl')}, {r('rmse', 6, 'rmse_mg_dl')}, {r('persistence', 6, 'persistence_mae_mg_dl')},
          {r('persistence - mae', 6, 'mae_improvement_vs_persistence')}, train_samples, test_samples,
          1 as train_participants, 1 as test_participants, event_type
        from errors join (select participant_id, event_type from split where rn = 1) using (participant_id)""",
    "boosted_grouped": ALL_BOOSTED
    + f"select participant_id, timestamp, glucose_mg_dl, target_30m, {r('prediction', 6, 'prediction_30m')} from predicted",
    "boosted_saved": ALL_BOOSTED
    + f"select participant_id, timestamp, glucose_mg_dl, target_30m, {r('prediction', 6, 'prediction_30m')} from predicted",
    "boosted_per_series": EACH_BOOSTED
    + f"select participant_id, timestamp, glucose_mg_dl, target_30m, {r('prediction', 6, 'prediction_30m')} from predicted",
    "boosted_per_series_eval": EACH_BOOSTED
    + f"""select participant_id, 'hgb' as model_name, 'within_patient_chronological' as split_strategy, mae_mg_dl, rmse_mg_dl,
          persistence_mae_mg_dl, {r('gain', 6, 'mae_improvement_vs_persistence')}, train_samples, test_samples,
          1 as train_participants, 1 as test_participants, event_type
        from (select participant_id, {r('avg(abs(prediction - target_30m))', 6, 'mae_mg_dl')},
            {r('sqrt(avg(power(prediction - target_30m, 2)))', 6, 'rmse_mg_dl')},
            {r('avg(abs(target_30m - glucose_mg_dl))', 6, 'persistence_mae_mg_dl')}, count(*) as test_samples,
            avg(abs(target_30m - glucose_mg_dl)) - avg(abs(prediction - target_30m)) as gain,
            any_value(c) - count(*) as train_samples from predicted group by 1)
          join (select participant_id, event_type from split where rn = 1) using (participant_id)""",
    "per_series_summary": RIDGE
    + f""", shown as (select round_even(mae, 2) as mae_mg_dl, round_even(rmse, 2) as rmse_mg_dl,
            round_even(persistence, 2) as persistence_mae_mg_dl from errors),
        gained as (select *, round_even(persistence_mae_mg_dl - mae_mg_dl, 2) as mae_improvement_vs_persistence from shown)
        select count(*) as participants, 'ridge' as model_name, 'within_patient_chronological' as split_strategy,
          {', '.join(f'round_even({kind}({c}), 2) as {name}_{c}' for kind, name in [('avg', 'mean'), ('median', 'median')]
             for c in ['mae_mg_dl', 'rmse_mg_dl', 'persistence_mae_mg_dl', 'mae_improvement_vs_persistence'])},
          count(*) filter (where mae_improvement_vs_persistence > 0) as participants_beating_persistence,
          count(*) filter (where mae_improvement_vs_persistence = 0) as participants_tying_persistence
        from gained""",
    "ingest_lines": INGESTED,
    "ingest_quoted": INGESTED,
}
