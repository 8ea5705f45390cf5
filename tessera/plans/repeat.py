"""DuckDB SQL that repeats hashed draws, permutations and sequential matching, for the queries that have them."""

from __future__ import annotations


def hashed(*parts: object, digits: int = 12) -> str:
    """The integer of ``windows.portable_hash``: numbers of Python are literals, texts are SQL."""
    text = " || '|' || ".join(f"'{p}'" if isinstance(p, int) else str(p) for p in parts)
    return f"('0x' || substr(md5({text}), 1, {digits}))::bigint"


def drawn(source: str, group: str, unit: str, columns: str, count: int, seed: int) -> str:
    """(rep, group, columns) of a bootstrap of each group's rows."""
    part = f"partition by {group} " if group else ""
    key, on = (f"{group}, ", f"using (i, {group})") if group else ("", "using (i)")
    numbered = f"select *, row_number() over ({part}order by {hashed(seed, chr(39) + 'unit' + chr(39), unit)}, {unit}) - 1 as i, count(*) over ({part}) as n from ({source})"
    return f"(with numbered as ({numbered}), places as (select {key}rep, {hashed(seed, 'rep', 'i')} % n as i from numbered, range(0, {count}) reps(rep)) select rep, {key}{columns} from places join numbered {on})"


def shuffled(source: str, block: str, unit: str, label: str, count: int, seed: int) -> str:
    """(rep, unit, label) with labels dealt anew within each block."""
    part, key = (f"partition by {block} ", f"{block}, ") if block else ("", "")
    on = f"using (i, {block})" if block else "using (i)"
    own = f"select {key}{label}, row_number() over ({part}order by {hashed(seed, chr(39) + 'unit' + chr(39), unit)}, {unit}) as i from ({source})"
    other = f"select {key}rep, {unit}, row_number() over (partition by rep{', ' + block if block else ''} order by {hashed(seed, 'rep', unit)}, {unit}) as i from ({source}), range(0, {count}) reps(rep)"
    return f"(select rep, {unit}, {label} from ({other}) join ({own}) {on})"


def welch(value: str, label: str) -> str:
    a, b = f"filter (where {label} = 1)", f"filter (where {label} = 0)"
    return f"(avg({value}) {a} - avg({value}) {b}) / nullif(sqrt(var_samp({value}) {a} / count({value}) {a} + var_samp({value}) {b} / count({value}) {b}), 0)"


def largest(own: str, permuted: str, count: int, keys: str = "metric") -> str:
    """Select with p_unadjusted and p_fwer of tables own (keys, difference, t) and permuted (rep, keys, t)."""
    same = " and ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    return f"select a.*, (1 + (select count(*) from {permuted} b where {same} and abs(b.t) >= abs(a.t) - 1e-12)) / {count + 1} as p_unadjusted, (1 + (select count(*) from (select max(abs(t)) as top from {permuted} group by rep) where top >= abs(a.t) - 1e-12)) / {count + 1} as p_fwer from {own} a"


def auroc(source: str, label: str, score: str, by: str = "") -> str:
    part, key = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    at = f"select {key}{score} as s, count(*) filter (where {label} = 1) as p, count(*) filter (where {label} = 0) as n from ({source}) group by {key}{score}"
    return f"(select {key}sum((tp - p / 2.0) * n) / (sum(p) * sum(n)) as auroc from (select *, sum(p) over ({part}order by s desc rows between unbounded preceding and current row) as tp from ({at})) {'group by ' + by if by else ''})"


def two_sided(z: str) -> str:
    """Normal two-sided p value: one minus the error function, by its series of positive terms."""
    x = f"(abs({z}) / sqrt(2))"
    terms = f"list_sum([exp((2 * n + 1) * ln({x}) - ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi()) - {x} * {x}) for n in range(0, 200)])"
    return f"case when {x} > 6 then 0.0 when {x} = 0 then 1.0 else greatest(0.0, 1 - 2 / sqrt(pi()) * {terms}) end"


def regression(rows: str, covariates: list[str], robust: str) -> str:
    """Select of the effect of g on y next to covariates: columns are made orthogonal one after the other, g last, so that its coefficient and error are plain sums.

    ``rows`` has y, g, cluster and what the covariates name. robust: "hc3" or "cluster".
    """
    columns = [*covariates, "g"]
    k = len(columns)
    ctes = [f"o_ as (select *, {', '.join(f'({c})::double as c{i}' for i, c in enumerate(columns))} from ({rows}))"]
    for i in range(k):
        minus = "".join(f" - sum(c{i} * o{j}) over () / sum(o{j} * o{j}) over () * o{j}" for j in range(i))
        ctes.append(f"o{i}_ as (select *, c{i}{minus} as o{i} from o{i - 1 if i else ''}_)")
    r = f"o{k - 1}"
    fit = "".join(f" - sum(y * o{j}) over () / sum(o{j} * o{j}) over () * o{j}" for j in range(k))
    ctes.append(f"e_ as (select *, y{fit} as e, {' + '.join(f'o{j} * o{j} / sum(o{j} * o{j}) over ()' for j in range(k))} as h from o{k - 1}_)")
    ctes.append(f"b_ as (select count(*) as n, count(*) filter (where g = 1) as n_exposed, count(*) filter (where g = 0) as n_reference, sum({r} * y) / sum({r} * {r}) as b, sum({r} * {r}) as rr, sum(({r} * e / (1 - h)) * ({r} * e / (1 - h))) as hc3 from e_)")
    ctes.append(f"s_ as (select sum(s * s) as s, count(*) as clusters from (select cluster, sum({r} * e) as s from e_ group by cluster))")
    square = "hc3" if robust == "hc3" else f"clusters / (clusters - 1) * (n - 1) / (n - {k}) * s"
    extra = "" if robust == "hc3" else ", clusters as n_clusters"
    return f"with {', '.join(ctes)}, t_ as (select *, sqrt({square}) / rr as se from b_, s_) select n, n_exposed, n_reference, round(b, 6) as estimate, round(se, 6) as se, round(b - 1.96 * se, 6) as ci_low, round(b + 1.96 * se, 6) as ci_high, round({two_sided('b / se')}, 6) as p_value{extra} from t_"


def matched(people: str, ratio: int, caliper: float, exact: bool = False, order: str = "difficulty", whole: bool = True, lowest: bool = False, gower: bool = False) -> str:
    """CTEs ``pairs`` and ``audit`` of the sequential greedy over ``people`` (who, age, is_case, sex, tie, band, nation): one case per step and stratum."""
    stratum = "coalesce('=' || sex, 'null')" if exact else "''"
    count = f"(select count(distinct who) from k where k.s = b.s and abs(k.age - b.age) <= {caliper})" if order == "difficulty" else "0"
    spread = "list_max([y.nation for y in near]) - list_min([y.nation for y in near])"
    band = "case when band is null then case when x.band is null then 0.0 else 1.0 end when x.band is null or x.band != band then 1.0 else 0.0 end"
    weight = "case when band is null and x.band is null then 1.0 else 2.0 end"
    far = f"({band} + least(1.0, abs(x.nation - nation) / case when {spread} > 0 then {spread} else 1.0 end)) / {weight}" if gower else "0.0"
    first = "x.age" if lowest else "abs(x.age - age)"
    least = ratio if whole else 1
    return f"""
    people as ({people}),
    k as (select who, age, tie, band, nation::double as nation, {stratum} as s from people where is_case = 0),
    b as (select who, age, band, nation::double as nation, {stratum} as s from people where is_case = 1),
    c as (select *, row_number() over (order by candidates, age, who) as turn, row_number() over (partition by s order by candidates, age, who) as step from (select *, {count} as candidates from b)),
    state as (
      select s, 0::bigint as step, ''::varchar as who, 0.0::double as age, 0::bigint as turn, 0 as eligible, []::struct(g double, f double, who varchar, tie varchar, age double)[] as taken,
        (select coalesce(list({{'who': who, 'age': age, 'tie': tie, 'band': band, 'nation': nation}}), []) from k where k.s = t.s) as free
      from (select distinct s from c) t
      union all
      select s, step, who, age, turn, eligible, taken, [x for x in free if not list_contains([y.who for y in taken], x.who)] as free
      from (select *, len(list_distinct([x.who for x in ranked]))::integer as eligible, case when len(ranked) >= {least} then ranked[1:{ratio}] else [] end as taken
        from (select *, list_sort([{{'g': {far}, 'f': {first}, 'who': x.who, 'tie': x.tie, 'age': x.age}} for x in near]) as ranked
          from (select c.s, c.step, c.who, c.age, c.turn, c.band, c.nation, state.free, [x for x in state.free if abs(x.age - c.age) <= {caliper}] as near from state join c on c.s = state.s and c.step = state.step + 1)))
    ),
    pairs as (select who as case_id, t.who as control_id, rank::integer as match_rank, turn as priority, age as case_value, t.age as control_value, abs(t.age - age) as value_distance, t.g as covariate_distance
      from (select who, turn, age, unnest(taken) as t, unnest(range(1, len(taken) + 1)) as rank from state where step > 0)),
    audit as (select who as case_id, age as case_value, len(taken) > 0 as matched, len(taken)::integer as n_controls, eligible as eligible_at_turn, case when len(taken) = {ratio} then null when len(taken) > 0 then 'partial_ratio' else 'too_few_controls' end as reason from state where step > 0)"""
