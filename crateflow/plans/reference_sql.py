"""SQL (DuckDB) that the catalog's queries are checked with."""

from __future__ import annotations

from crateflow.functions.columns import AXIS_NAMES, ENHARMONIC, FIFTHS, MOODS, SCHEMA_HASH
from crateflow.operators.walk import Sampler


def _num(path: str) -> str:
    return f"try_cast(json_extract_string(j, '$.{path}') as double)"


_CANON = "case k " + " ".join(f"when '{a}' then '{b}'" for a, b in ENHARMONIC.items()) + " else k end"
_MAJOR = "case kc " + " ".join(f"when '{k}' then {2 * i}" for i, k in enumerate(FIFTHS)) + " end"
_AXES = [a for a in AXIS_NAMES if not a.startswith("key.fifths")]

LIB = f"""
raw as materialized (
  select *, case when json_valid(feature_json) then feature_json end as j,
    case when len(clap_embedding) = 512 and not list_bool_or(list_transform(clap_embedding, lambda x: x is null or isnan(x))) then clap_embedding::double[] end as e
  from tracks),
keyed as (
  select *, trim(json_extract_string(j, '$.key.key')) as k0, lower(coalesce(nullif(json_extract_string(j, '$.key.mode'), ''), json_extract_string(j, '$.key.scale'), '')) as m0 from raw),
canon as (
  select *, {_CANON} as kc from (select *, upper(substr(k0, 1, 1)) || substr(k0, 2) as k from keyed)),
slotted as (
  select *, {_MAJOR} as major, case when contains(m0, 'major') then 'major' when contains(m0, 'minor') then 'minor' end as kind from canon),
placed as (
  select *, case when kind = 'major' then major when kind = 'minor' then (major - 6 + 24) % 24 + 1 end as slot from slotted),
lib as materialized (
  select id, file_path, title, artist, duration_sec, feature_json, clap_embedding, e, slot,
    json_extract_string(j, '$.key.scale') as scale, nullif(json_extract_string(j, '$.version'), '') as version, nullif(json_extract_string(j, '$.schema_hash'), '') as schema_hash,
    coalesce(list_contains(json_keys(j), 'mood'), false) as has_mood, coalesce({_num("tempo.bpm")}, 0.0) as bpm,
    {", ".join(f"{_num('mood.' + m)} as {m}" for m in MOODS)},
    [{", ".join(f"coalesce({_num(a)}, 0.0)" for a in _AXES)}, coalesce(cos(slot * pi() / 12), 0.0), coalesce(sin(slot * pi() / 12), 0.0)]::double[] as vector,
    case when e is not null then list_transform(e, lambda x: case when list_inner_product(e, e) > 0 then x / sqrt(list_inner_product(e, e)) else x * 0.0 end) end as unit
  from placed)"""

#: The stated query set: every row whose id is divisible by 20.
Q = "q as materialized (select * from lib where id % 20 = 0 and unit is not null)"
STATS = """
axes as (select unnest(range(0, 20)) as axis),
stats as materialized (select axis, avg(vector[axis + 1]) as mu, case when max(vector[axis + 1]) > min(vector[axis + 1]) then stddev_pop(vector[axis + 1]) else 1.0 end as sigma from lib, axes group by axis),
sig as materialized (select list(sigma order by axis) as s from stats)"""
STEPS = "least(abs({a} - {b}) % 24, 24 - abs({a} - {b}) % 24)"


def steps(a: str, b: str) -> str:
    return f"case when {a} is not null and {b} is not null then {STEPS.format(a=a, b=b)} end"


def verdict(a: str, b: str, most: int = 2) -> str:
    s = steps(a, b)
    return f"case when ({s}) is null or ({s}) <= {most} then 'allow' when ({s}) <= {most + 2} then 'penalise' else 'block' end"


def level(s: Sampler) -> str:
    """First box that a row of lib passes, null for none."""
    out = "case"
    for k, box in enumerate(s.boxes()):
        tests = ["has_mood"] if box else ["true"]
        for name, b in box.items():
            v = name.split(".", 1)[-1]
            tests += [f"{v} is not null", *[f"{v} {sign} {b[end]!r}::double" for end, sign in (("min", ">="), ("max", "<=")) if end in b]]
        out += f" when {' and '.join(tests)} then {k}"
    return out + " end"


def tempo_fails(now: str, cand: str, centre: str, share: float) -> str:
    return f"({now} > 0 and {cand} > 0 and not ({centre} > 0 and abs({cand} - {centre}) / {centre} <= {share!r}::double))"


def walk(s: Sampler, limit: int) -> str:
    """The gated, banded walk from the stated query set, one group of CTEs per step."""
    parts = [LIB, Q, f"lv as materialized (select id, slot, bpm, unit, {level(s)} as level from lib where unit is not null)", "s0 as materialized (select id as walk_id, slot, bpm, unit, bpm as seed_bpm, [id] as visited from q)"]
    rows = []
    for t in range(limit):
        sched = s.band_schedule[t % len(s.band_schedule)]
        drift = (1 + s.tempo_drift_per_step) ** t
        centre = f"(case when s.seed_bpm > 0 then s.seed_bpm * {drift!r}::double else s.bpm end)" if s.tempo_drift_per_step else "s.bpm"
        near, mid = f"ceil(n * {s.near_quantile!r}::double)", f"ceil(n * {s.mid_quantile!r}::double)"
        start = {"Near": f"case when {near} > 0 then 1 end", "Mid": f"case when {mid} - {near} > 0 then {near} + 1 end", "Far": f"case when {mid} < n then {mid} + 1 end"}
        order = [sched, *[b for b in ("Near", "Mid", "Far") if b != sched]]
        want = "coalesce(" + ", ".join(start[b] for b in order) + ")"
        label = "case " + " ".join(f"when ({start[b]}) is not null then '{b}'" for b in order) + " end"
        parts += [
            f"c{t} as materialized (select s.walk_id, l.id, l.level, round(list_inner_product(s.unit, l.unit), 12) as sim, {verdict('s.slot', 'l.slot', s.key_max_steps)} as v, {tempo_fails('s.bpm', 'l.bpm', centre, s.tempo_max_step_pct)} as off from s{t} s, lv l where not list_contains(s.visited, l.id))",
            f"g{t} as materialized (select * from c{t} where v <> 'block' and not off and level is not null)",
            f"m{t} as (select walk_id, min(level) as level from g{t} group by walk_id)",
            f"r{t} as materialized (select g.*, row_number() over (partition by g.walk_id order by sim desc, case v when 'allow' then 0 else 1 end, g.id) as rn, count(*) over (partition by g.walk_id) as n from g{t} g join m{t} m on g.walk_id = m.walk_id and g.level = m.level)",
            f"""p{t} as materialized (
  select walk_id, id, sim, case when n < 20 then '{sched}' else {label} end as band,
    case when n < 20 then 'Small library (n=' || n || '<20): greedy nearest-by-CLAP (sched {sched})' else {label} || ' CLAP pick (sched {sched})' end || case when level > 0 then ', mood relaxed x' || level else '' end as reason
  from r{t} where rn = case when n < 20 then 1 else {want} end
  union all
  select walk_id, id, sim, '{sched}', 'Fallback: gates empty, global-nearest-by-CLAP (sched {sched})' from (select *, row_number() over (partition by walk_id order by sim desc, id) as k from c{t} where walk_id not in (select walk_id from m{t})) where k = 1)""",
            f"s{t + 1} as materialized (select p.walk_id, l.slot, l.bpm, l.unit, s.seed_bpm, list_append(s.visited, p.id) as visited from p{t} p join lv l on l.id = p.id join s{t} s on s.walk_id = p.walk_id)",
        ]
        rows.append(f"select walk_id, {t + 1} as position, id, band, round(1 - sim, 4) as distance, reason from p{t}")
    return "with " + ",\n".join(parts) + "\n" + "\nunion all ".join(rows)


def legacy_distance(a: str, b: str) -> str:
    return f"round(sqrt(list_sum(list_transform(range(1, 21), lambda i: power(({a}[i] - {b}[i]) / sig.s[i], 2))) / 20), 12)"


def legacy_walk(limit: int, schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near"), hold: int = 3) -> str:
    h = hold + 1
    parts = [LIB, STATS, "lv as materialized (select id, vector from lib)", "s0 as materialized (select id as walk_id, vector, [id] as visited from lib where id % 20 = 0)"]
    rows = []
    for t in range(limit):
        sched = schedule[t % len(schedule)]
        fits = {"Near": "d > 0 and d <= 0.3", "Mid": "d > 0.3 and d <= 0.7", "Far": "free > 0.7 and held <= 0.3"}[sched]
        parts += [
            f"""c{t} as materialized (select walk_id, id, visited, d, held, round(sqrt(greatest(d2 - power((sv[{h}] - lv[{h}]) / sg[{h}], 2) + power(sv[{h}] / sg[{h}], 2), 0) / 20), 12) as free from (
  select s.walk_id, l.id, s.visited, s.vector as sv, l.vector as lv, sig.s as sg, abs(s.vector[{h}] - l.vector[{h}]) as held,
    list_sum(list_transform(range(1, 21), lambda i: power((s.vector[i] - l.vector[i]) / sig.s[i], 2))) as d2, round(sqrt(d2 / 20), 12) as d
  from s{t} s, lv l, sig where not list_contains(s.visited, l.id)))""",
            f"p{t} as materialized (select * from (select *, ({fits}) as hit, row_number() over (partition by walk_id order by case when {fits} then 0 else 1 end, d, id) as k from c{t}) where k = 1)",
            f"s{t + 1} as materialized (select p.walk_id, l.vector, list_append(p.visited, p.id) as visited from p{t} p join lv l on l.id = p.id)",
        ]
        actual = "case when d <= 0.3 then 'Near' when d <= 0.7 then 'Mid' else 'Far' end"
        rows.append(f"select walk_id, {t + 1} as position, id, case when hit then '{sched}' else {actual} end as band, round(d, 4) as distance, case when hit then '{sched} band transition from seed' else 'Fallback: scheduled {sched} empty, global-nearest (actual ' || {actual} || ') from seed' end as reason from p{t}")
    return "with " + ",\n".join(parts) + "\n" + "\nunion all ".join(rows)


_ZED = """
dims as materialized (select i, avg(x) as mu, case when stddev_pop(x) > 1e-12 then stddev_pop(x) else 1.0 end as sigma from (select unnest(e) as x, generate_subscripts(e, 1) as i from lib where unit is not null) group by i),
zs as materialized (select list(sigma order by i) as s from dims),
std2 as materialized (select axis, case when stddev_pop(vector[axis + 1]) > 1e-12 then stddev_pop(vector[axis + 1]) else 1.0 end as sigma from lib, (select unnest(range(0, 20)) as axis) where unit is not null group by axis),
sig2 as materialized (select list(sigma order by axis) as s from std2),
zl as materialized (select id, unit, list_inner_product(unit, unit) = 0 as z0, list_transform(range(1, 513), lambda i: e[i] / zs.s[i]) as ze, list_transform(range(1, 21), lambda i: vector[i] / sig2.s[i]) as zv from lib, zs, sig2 where unit is not null),
pairs as materialized (
  select a.id as query_id, b.id, case when a.z0 and b.z0 then 0.0 when a.z0 or b.z0 then 1.0 else round(1 - greatest(least(list_inner_product(a.unit, b.unit), 1.0), -1.0), 12) end as cosine,
    round(list_distance(a.ze, b.ze) / sqrt(512), 12) as d_clap, round(list_distance(a.zv, b.zv) / sqrt(20), 12) as d_essentia
  from zl a, zl b where a.id % 20 = 0 and a.id <> b.id)"""


def compare_walk(limit: int, schedule: tuple[str, ...] = ("Near", "Mid", "Far", "Mid", "Near")) -> str:
    parts = [
        LIB,
        Q,
        "un as materialized (select id, unit, list_inner_product(unit, unit) = 0 as zero from lib where unit is not null)",
        "pr as materialized (select a.id as query_id, b.id, case when a.zero and b.zero then 0.0 else round(1 - greatest(least(round(list_inner_product(a.unit, b.unit), 12), 1.0), -1.0), 12) end as d from un a, un b where a.id <> b.id)",
        "nr as (select d, row_number() over (order by d) - 1 as k, count(*) over () as n from pr where query_id < id)",
        "cut as materialized (select max(d) filter (where k = floor(0.33::double * n)) as low, max(d) filter (where k = floor(0.66::double * n)) as high from nr)",
        "s0 as (select id as walk_id, id as at, [id] as visited from q)",
    ]
    rows = []
    for t in range(limit):
        band = schedule[t % len(schedule)]
        fits = {"Near": "d <= low + 1e-12", "Mid": "d > low and d <= high", "Far": "d > high"}[band]
        order = f"case when {fits} then 0 else 1 end, case when ({fits}) and {str(band == 'Far').lower()} then -d else d end, id"
        parts += [
            f"p{t} as materialized (select * from (select s.walk_id, s.visited, pr.id, pr.d, row_number() over (partition by s.walk_id order by {order}) as k from s{t} s join pr on pr.query_id = s.at, cut where not list_contains(s.visited, pr.id)) where k = 1)",
            f"s{t + 1} as (select walk_id, id as at, list_append(visited, id) as visited from p{t})",
        ]
        rows.append(f"select walk_id, {t + 1} as position, id, '{band}' as band, round(d, 4) as distance from p{t}")
    return "with " + ",\n".join(parts) + "\n" + "\nunion all ".join(rows)


def _rank(column: str, out: str) -> str:
    return f"rank() over (order by {column}) + (count(*) over (partition by {column}) - 1) / 2.0 as {out}"


PLAYED = """
pe as (select distinct playlist_id, position, track_id, title, artist, file, band, distance, reason from playlist_entries),
pl as (select distinct playlist_id, seed_id, sampler from playlists)"""
_STALE = f"(feature_json is null or version is distinct from '1.1' or (schema_hash is not null and schema_hash <> '{SCHEMA_HASH}'))"
_ORDERED = PLAYED + """,
tr as (select pl.playlist_id, 0 as position, seed_id as track_id from pl union all select playlist_id, position, track_id from pe),
ordered as (select tr.playlist_id, row_number() over (partition by tr.playlist_id order by tr.position) as n, t.file_path, t.title, t.artist, t.duration_sec from tr join tracks t on t.id = tr.track_id),
lines as (select playlist_id, n, '../' || substr(file_path, 6) as path, coalesce(nullif(artist, ''), 'Unknown') || ' - ' || coalesce(nullif(title, ''), 'Unknown') as name, case when duration_sec > 0 then floor(duration_sec)::bigint else -1 end as sec from ordered)"""


def _summary() -> str:
    at = {a: i + 1 for i, a in enumerate(AXIS_NAMES)}

    def num(axis: str, digits: int) -> str:
        return f"printf('%.{digits}f', vector[{at[axis]}])"

    moods = " || ', ".join(f"{m}=' || {num('mood.' + m, 2)}" for m in MOODS)
    lines = [
        "n || '. id=' || id || ' | ' || case when position = 0 then 'SEED' else coalesce(band, '') end",
        "'   ''' || title || ''' - ' || artist",
        f"'   Duration: ' || {num('duration_sec', 1)} || 's | Loudness: ' || {num('loudness.integrated', 1)} || ' LUFS (range ' || {num('loudness.range', 1)} || ')'",
        f"'   Tempo: ' || {num('tempo.bpm', 0)} || ' BPM (conf ' || {num('tempo.confidence', 2)} || ') | Key: ' || coalesce(scale, 'N/A')",
        f"'   Spectral: centroid=' || {num('spectral.centroid', 0)} || ' Hz, rolloff=' || {num('spectral.rolloff', 0)} || ' Hz, flatness=' || {num('spectral.flatness', 3)}",
        f"'   Rhythm: danceability=' || {num('rhythm.danceability', 2)} || ', onset_rate=' || {num('rhythm.onset_rate', 1)} || '/sec'",
        f"'   Mood: {moods}",
        "''",
    ]
    head = ["'" + "=" * 60 + "'", "'PLAYLIST SUMMARY'", "'" + "=" * 60 + "'", "'Seed: id=' || id || ' ''' || title || ''' by ' || artist", "'Schedule: Near -> Mid -> Far -> Mid -> Near (' || c || ' tracks)'", "'Hold axis: tempo.bpm'", "''"]
    return f"""with {LIB}, {PLAYED},
tr as (select playlist_id, 0 as position, seed_id as id, null as band from pl union all select playlist_id, position, track_id, band from pe),
x as (select tr.playlist_id, position, lib.id, tr.band, coalesce(nullif(title, ''), 'Unknown') as title, coalesce(nullif(artist, ''), 'Unknown') as artist, scale, vector, row_number() over w - 1 as n, count(*) over (partition by playlist_id) as c from tr join lib using (id) window w as (partition by playlist_id order by position))
{" union all ".join(f"select playlist_id, (8 + 8 * n + {k})::int as line_no, {text} as line from x" for k, text in enumerate(lines))}
union all {" union all ".join(f"select playlist_id, {k + 1}, {text} from x where position = 0" for k, text in enumerate(head))}"""


def sql() -> dict[str, str]:
    box = Sampler(mood_box={"mood.sad": {"min": 0.9}, "aggressive": {"max": 0.1}, "party": {"min": 0.8}})
    lib, q = f"with {LIB}", f"with {LIB}, {Q}"
    anchors = f"""{lib}, {PLAYED},
st as (select pl.playlist_id, 0 as position, seed_id as id from pl union all select playlist_id, position, track_id from pe),
kn as (select st.*, slot, bpm, lag(slot) over w as pslot, lag(bpm) over w as pbpm from st join lib using (id) window w as (partition by playlist_id order by position)),
fl as (select sampler, ({verdict("pslot", "slot")}) <> 'block' as key_ok, case when pbpm > 0 and bpm > 0 then abs(bpm - pbpm) / pbpm <= 0.1::double else true end as tempo_ok from kn join pl using (playlist_id) where position > 0)"""
    gate = f"{q}, lv as (select *, {level(Sampler())} as level from lib where unit is not null)"
    out = {
        "library_scan": f"{lib} select id, version, schema_hash, slot, has_mood, bpm, {', '.join(MOODS)} from lib",
        "feature_vectors": f"{lib} select id, axis, round(vector[axis + 1], 6) as value from lib, (select unnest(range(0, 20)) as axis)",
        "axis_stats": f"{lib}, {STATS} select axis, round(mu, 6) as mu, round(sigma, 6) as sigma from stats",
        "coverage": f"{lib} select count(*) as n_tracks, count(e) as n_clap, case when count(*) > 0 then count(e) / count(*) else 0.0 end as clap_coverage from lib",
        "key_slots": f"{lib} select id, slot from lib",
        "key_verdicts": f"{lib}, {PLAYED} select {verdict('a.slot', 'b.slot')} as verdict, count(*) as n from pe join pl using (playlist_id) join lib a on a.id = seed_id join lib b on b.id = track_id group by 1",
        "tempo_gate": f"{lib}, {PLAYED} select case when a.bpm > 0 then abs(b.bpm - a.bpm) / a.bpm <= 0.1::double else false end as ok, count(*) as n from pe join pl using (playlist_id) join lib a on a.id = seed_id join lib b on b.id = track_id group by 1",
        "mood_box": f"{lib} select id from lib where sad is not null and sad >= 0.5 and party is not null and party <= 0.6",
        "gate_filter": f"{gate} select s.id as query_id, l.id, case {verdict('s.slot', 'l.slot')} when 'allow' then 0 else 1 end as verdict from q s, lv l where s.id <> l.id and {verdict('s.slot', 'l.slot')} <> 'block' and not {tempo_fails('s.bpm', 'l.bpm', 's.bpm', 0.1)}",
        "mood_relax_levels": f"{q}, lv as (select *, {level(box)} as level from lib where unit is not null) select s.id as query_id, min(level) as level from q s, lv l where s.id <> l.id and level is not null and {verdict('s.slot', 'l.slot')} <> 'block' and not {tempo_fails('s.bpm', 'l.bpm', 's.bpm', 0.1)} group by s.id",
        "cosine_topk": f"{q}, sims as (select q.id as query_id, l.id, round(list_inner_product(q.unit, l.unit), 12) as sim from q, lib l where l.unit is not null and l.id <> q.id), rk as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from sims) select query_id, id, rank, round(sim, 6) as sim from rk where rank <= 5",
        "global_nearest": f"{q}, sims as (select q.id as query_id, l.id, round(list_inner_product(q.unit, l.unit), 12) as sim from q, lib l where l.unit is not null and l.id <> q.id), rk as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from sims) select query_id, id, round(1 - sim, 4) as distance from rk where rank = 1",
        "similarity_bands": f"{q}, sims as (select q.id as query_id, l.id, round(list_inner_product(q.unit, l.unit), 12) as sim from q, lib l where l.unit is not null and l.id <> q.id), rk as (select *, row_number() over (partition by query_id order by sim desc, id) as rank, count(*) over (partition by query_id) as n from sims), b as (select *, case when rank > ceil(n * 0.4::double) then 'Far' when rank > ceil(n * 0.1::double) then 'Mid' else 'Near' end as band from rk) select query_id, band, count(*) as n, min(rank) as first_rank, sum(id)::bigint as id_sum, round(max(sim), 6) as most, round(min(sim), 6) as least from b group by 1, 2",
        "playlist_walk": walk(Sampler(), 9),
        "playlist_walk_drift": walk(Sampler(tempo_drift_per_step=0.03), 9),
        "playlist_walk_moodbox": walk(box, 9),
        "playlist_walk_fallback": walk(Sampler(mood_box={"sad": {"min": 1.5}}), 9),
        "pairwise_report": f"{lib}, {_ZED} select query_id, count(*) as n, round(avg(cosine), 6) as mean_cosine, round(avg(d_clap), 6) as mean_clap, round(avg(d_essentia), 6) as mean_essentia, round(min(cosine), 6) as least_cosine from pairs group by query_id",
        "spearman_pairs": f"{lib}, {_ZED}, r as (select {_rank('d_clap', 'ra')}, {_rank('d_essentia', 'rb')} from pairs) select count(*) as n, round(corr(ra, rb), 6) as rho from r",
        "nn_agreement": f"{lib}, {_ZED}, r as (select query_id, id, row_number() over (partition by query_id order by d_clap, id) as ra, row_number() over (partition by query_id order by d_essentia, id) as rb from pairs), h as (select query_id, count(*) filter (where ra <= 3 and rb <= 3) as hits, max(case when ra = 1 and rb = 1 then 1 else 0 end) as same from r group by query_id) select count(*) as n, round(avg(same), 6) as exact_match, round(avg(hits / 3.0), 6) as top3_overlap from h",
        "distance_cuts": f"{lib}, {_ZED}, r as (select d_clap, row_number() over (order by d_clap) - 1 as k, count(*) over () as n from pairs) select round(max(d_clap) filter (where k = floor(0.33::double * n)), 6) as low, round(max(d_clap) filter (where k = floor(0.66::double * n)), 6) as high from r",
        "candidate_pool_spearman": f"with {PLAYED}, m as (select track_id, avg(distance) filter (where sampler = 'clap') as a, avg(distance) filter (where sampler = 'legacy') as b from pe join pl using (playlist_id) where distance is not null group by 1), x as (select round(a, 9) as a, round(b, 9) as b from m where a is not null and b is not null), r as (select {_rank('a', 'ra')}, {_rank('b', 'rb')} from x) select count(*) as n, round(corr(ra, rb), 6) as rho from r",
        "legacy_bands": f"{lib}, {STATS}, d as (select s.id as query_id, l.id, {legacy_distance('s.vector', 'l.vector')} as d from lib s, lib l, sig where s.id % 20 = 0 and s.id <> l.id), b as (select *, case when d > 0 and d <= 0.3 then 'Near' when d > 0.3 and d <= 0.7 then 'Mid' when d > 0.7 then 'Far' end as band from d) select query_id, band, count(*) as n, round(min(d), 6) as least, round(max(d), 6) as most from b where band is not null group by 1, 2",
        "directed_jump": f"{lib}, {STATS}, d as (select s.id as query_id, l.id, {legacy_distance('s.vector', 'l.vector')} as d, abs(s.vector[4] - l.vector[4]) as held, round(sqrt(greatest(list_sum(list_transform(range(1, 21), lambda i: case when i = 4 then power(s.vector[4] / sig.s[4], 2) else power((s.vector[i] - l.vector[i]) / sig.s[i], 2) end)), 0) / 20), 12) as free from lib s, lib l, sig where s.id % 20 = 0 and s.id <> l.id), f as (select *, row_number() over (partition by query_id order by d, id) as k, count(*) over (partition by query_id) as n from d where free > 0.7 and held <= 0.3) select query_id, id, n, round(d, 6) as d from f where k = 1",
        "compare_walk": compare_walk(9),
        "legacy_walk": legacy_walk(9),
        "legacy_walk_scheduled": f"select walk_id, position, id, case (position - 1) % 5 when 0 then 'Near' when 2 then 'Far' when 4 then 'Near' else 'Mid' end as band from ({legacy_walk(9)})",
        "anchor_adherence": anchors + " select sampler, 1.0::double as mood, round(avg(key_ok::int), 6) as key, round(avg(tempo_ok::int), 6) as tempo, count(*) filter (where not key_ok) as key_violations from fl group by sampler",
        "band_means": f"with {PLAYED} select sampler, coalesce(band, '?') as band, round(avg(coalesce(distance, 0.0)), 6) as mean_distance, count(*) as n from pe join pl using (playlist_id) group by 1, 2",
        "stale_rows": f"{lib} select id, {_STALE} as stale from lib",
        "ingest_plan": f"{lib}, f as (select distinct file_path from ingest_log) select f.file_path, id, case when id is null then 'process' when {_STALE} then 're-extract' else 'skip' end as action, clap_embedding is null as needs_embedding from f left join lib using (file_path)",
        "upsert_tracks": f"""{lib}, f as (select distinct file_path from ingest_log), p as (select file_path, id, duration_sec, case when f.file_path is null then 'kept' when id is null then 'process' when {_STALE} then 're-extract' else 'skip' end as action, feature_json is not null as has_json from f full join lib using (file_path)),
x as (select *, not ends_with(lower(file_path), '.ogg') as worked, row_number() over (partition by id is null order by file_path) as k from p)
select coalesce(id, (select max(id) from tracks) + k) as id, file_path, case when action in ('kept') then 'kept' when action = 'skip' then 'skipped' when not worked then 'failed' when action = 'process' then 'processed' else 're-extracted' end as status, case when action in ('process', 're-extract') and worked then length(file_path)::double else duration_sec end as duration_sec, has_json or (action in ('process', 're-extract') and worked) as has_json from x""",
        "seed_search": "select id from tracks where contains(lower(coalesce(title, '')), 'mirror')",
        "m3u_lines": f"with {_ORDERED} select playlist_id, 1 as line_no, '#EXTM3U' as line from (select distinct playlist_id from lines) union all select playlist_id, 2 * n, '#EXTINF:' || sec || ',' || name from lines union all select playlist_id, 2 * n + 1, path from lines",
        "pls_lines": f"with {_ORDERED}, c as (select playlist_id, count(*) as c from lines group by 1) select playlist_id, 1 as line_no, '[playlist]' as line from c union all select playlist_id, 3 * n - 1, 'File' || n || '=' || path from lines union all select playlist_id, 3 * n, 'Title' || n || '=' || name from lines union all select playlist_id, 3 * n + 1, 'Length' || n || '=' || sec from lines union all select playlist_id, 3 * c + 2, 'NumberOfEntries=' || c from c union all select playlist_id, 3 * c + 3, 'Version=2' from c",
        "text_summary": _summary(),
        "playlist_members": f"with {PLAYED} select playlist_id, position, track_id as id, coalesce(file, '') as file, coalesce(title, '') as title, coalesce(artist, '') as artist, band, round(distance, 4) as distance, coalesce(reason, '') as reason from pe",
    }
    return out
