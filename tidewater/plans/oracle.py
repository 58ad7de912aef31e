"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code, in plain SQL over the driver tables
(registered as views): each query repeats the feed derivation as a CTE and
then states the converter rules again in DuckDB's dialect. Helpers below
produce SQL text; ``ORACLE`` maps query name -> SQL.
"""

from __future__ import annotations

from ..sources.feeds import oracle_feed_sql

# ---- fixed values (same as tidewater.functions.text, in RE2 syntax) ----------
WS = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
FLOAT_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INT_RE = r"^\s*[+-]?[0-9]+\s*$"
# -----------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_CHARS = "".join(chr(c) for c in (0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(x: str) -> str:
    return f"trim({x}, {q(WS_CHARS)})"


def na(x: str) -> str:
    toks = ", ".join(q(t) for t in NA_TOKENS)
    return f"(case when cast({x} as varchar) in ({toks}) then null else cast({x} as varchar) end)"


def blank_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def text_or_empty(x: str) -> str:
    return strip(f"coalesce(cast({x} as varchar), '')")


def is_float(x: str) -> str:
    return f"regexp_matches({x}, {q(FLOAT_RE)})"


def is_int(x: str) -> str:
    return f"regexp_matches({x}, {q(INT_RE)})"


def num(x: str) -> str:
    return f"(case when {is_float(x)} then cast({x} as double) end)"


def num0(x: str) -> str:
    return f"(case when {blank_null(x)} is null then 0.0 when {is_float(x)} then cast({x} as double) end)"


def bad_num(x: str) -> str:
    return f"({blank_null(x)} is not null and not {is_float(x)})"


def num_check(x: str, label: str) -> str:
    return f"(case when {bad_num(x)} then {q('Invalid number for ' + label + ': ')} || {x} end)"


def uuid_of(*parts: str) -> str:
    h = "md5(concat_ws(':', " + ", ".join(f"cast({p} as varchar)" for p in parts) + "))"
    return f"concat_ws('-', substr({h},1,8), substr({h},9,4), substr({h},13,4), substr({h},17,4), substr({h},21,12))"


def date_dmy(x: str) -> str:
    s = strip(x)
    return f"(case when regexp_matches({s}, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') then cast(try_strptime({s}, '%d-%m-%Y') as date) end)"


def date_ymd(x: str) -> str:
    s = strip(x)
    return f"(case when regexp_matches({s}, '^[0-9]{{8}}$') then cast(try_strptime({s}, '%Y%m%d') as date) end)"


def strict_date(x: str, kind: str) -> tuple[str, str]:
    present = f"(coalesce({strip(x)}, '') <> '')"
    parsed = date_dmy(x) if kind == "dmy" else date_ymd(x)
    value = f"(case when {present} then {parsed} end)"
    err = f"(case when {present} and {value} is null then 'Invalid date format: ' || {x} end)"
    return value, err


HMS = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9]):([0-5]?[0-9])$"


def strict_time(x: str) -> tuple[str, str]:
    s = strip(x)
    present = f"(coalesce({s}, '') <> '')"
    ok = f"regexp_matches({s}, {q(HMS)})"
    parts = ", ".join(f"lpad(regexp_extract({s}, {q(HMS)}, {i}), 2, '0')" for i in (1, 2, 3))
    value = f"(case when {present} and {ok} then concat_ws(':', {parts}) end)"
    err = f"(case when {present} and not {ok} then 'Invalid time format: ' || {x} end)"
    return value, err


def j1_ctes(src: str, date_x: str, time_x: str, out: str) -> str:
    """J1 as CTE stages; ``out`` gets columns _ts and _ts_err (plus helpers)."""
    d1 = "split_part(" + strip("coalesce(cast(" + date_x + " as varchar), '')") + ", '.', 1)"
    t0 = "upper(" + strip("coalesce(cast(" + time_x + " as varchar), '')") + ")"
    return f"""
{out}_a as (select *, {d1} as _d1, {t0} as _t0 from {src}),
{out}_b as (select *, ({strip("replace(replace(_t0, 'UTC', ''), 'GMT', '')")}) as _t1 from {out}_a),
{out}_c as (select *, (case when contains(_t1, ',') then {strip("split_part(_t1, ',', 1)")} else _t1 end) as _t2 from {out}_b),
{out}_d as (select *, string_split(_t2, ':') as _ps, (_t0 = '' or _t0 in ('NA', 'NAN')) as _mid,
    (case when contains(_d1, '-') then {date_dmy('_d1')} when regexp_matches(_d1, '^[0-9]{{8}}$') then cast(try_strptime(_d1, '%Y%m%d') as date) end) as _day
    from {out}_c),
{out}_e as (select *, (len(_ps) = 2 and {is_int('_ps[1]')} and {is_float('_ps[2]')}) as _two,
    (len(_ps) = 3 and {is_int('_ps[1]')} and {is_int('_ps[2]')} and {is_float('_ps[3]')}) as _three from {out}_d),
{out}_f as (select *, (case when _three then try_cast(_ps[1] as bigint) else 0 end) as _hh,
    (case when _three then try_cast(_ps[2] as bigint) when _two then try_cast(_ps[1] as bigint) end) as _mi,
    (case when _three then try_cast(_ps[3] as double) when _two then try_cast(_ps[2] as double) end) as _ss from {out}_e),
{out}_g as (select *, (_mid or ((_two or _three) and abs(_hh) < 10000000 and abs(_mi) < 1000000000 and abs(_ss) < 1e11)) as _tok,
    cast(trunc(_ss) as bigint) as _secs from {out}_f),
{out}_h as (select *, (case when _mid then 0 else _hh * 3600000000 + _mi * 60000000 + _secs * 1000000
    + cast(trunc((_ss - _secs) * 1000000.0) as bigint) end) as _total from {out}_g),
{out} as (select *, (case when _day is not null and _tok then cast(_day as timestamp)
    + to_microseconds(_total - (((_total % 1000) + 1000) % 1000)) end) as _ts,
    (case when _day is null then 'Invalid date format: ' || _d1 when not _tok then 'Invalid time format: ' || _t2 end) as _ts_err
    from {out}_h)"""


def dms(x: str) -> tuple[str, str]:
    """J2 on one column: (value, error)."""
    s = strip(x)
    two = f"regexp_matches({s}, {q('^' + NOT_WS + '+' + WS + '+' + NOT_WS + '+$')})"
    d = f"regexp_extract({s}, {q('^(' + NOT_WS + '+)')}, 1)"
    direction = f"regexp_extract({s}, {q('(' + NOT_WS + '+)$')}, 1)"
    p = f"string_split({d}, ':')"
    ok = (f"coalesce({two} and len({p}) = 3 and {is_float(p + '[1]')} and {is_float(p + '[2]')} "
          f"and {is_float(p + '[3]')}, false)")
    deg = f"(cast({p}[1] as double) + cast({p}[2] as double) / 60 + cast({p}[3] as double) / 3600)"
    sign = f"(case when {direction} in ('S', 'W') then -1.0 else 1.0 end)"
    value = f"(case when {ok} then round({deg} * {sign}, 6) end)"
    err = f"(case when not {ok} then 'Invalid coordinate format: ' || coalesce({x}, 'None') end)"
    return value, err


def iso_ts(x: str) -> str:
    iso = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2})(:[0-9]{2}(?:\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
    s = strip(x)
    base = f"(replace(regexp_extract({s}, {q(iso)}, 1), ' ', 'T') || coalesce(nullif(regexp_extract({s}, {q(iso)}, 2), ''), ':00'))"
    zone = f"replace(regexp_extract({s}, {q(iso)}, 3), ':', '')"
    east = (f"(case when {zone} in ('', 'Z') then 0 else (case when starts_with({zone}, '-') then -1 else 1 end) * "
            f"(cast(substr({zone}, 2, 2) as integer) * 60 + cast(coalesce(nullif(substr({zone}, 4, 2), ''), '0') as integer)) end)")
    return (f"(case when regexp_matches({s}, {q(iso)}) then try_strptime({base}, "
            f"['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f']) - to_minutes({east}) end)")


def iso_text(ts: str) -> str:
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when strftime({ts}, '%f') <> '000000' "
            f"then '.' || strftime({ts}, '%f') else '' end)")


def feed_cte(name: str, alias: str | None = None) -> str:
    return f"{alias or name} as ({oracle_feed_sql(name)})"


# ---- converters as CTE chains -------------------------------------------------

def ais_ctes() -> str:
    cols = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "VesselName", "IMO"]
    n = ", ".join(f"{na(c)} as {c.lower()}" for c in cols)
    ts_text = text_or_empty(blank_null("basedatetime"))
    checks = ", ".join([num_check("sog", "SOG"), num_check("heading", "Heading"), num_check("lat", "LAT"),
                        num_check("lon", "LON"), "(case when _ts is null then 'Invalid timestamp: ' || _tt end)"])
    return f"""{feed_cte('ais_raw')},
ais_n as (select file_name, row_no, {n} from ais_raw),
ais_t as (select *, {ts_text} as _tt from ais_n),
ais_u as (select *, {iso_ts('_tt')} as _ts from ais_t),
ais as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    _ts as logged_timestamp, {text_or_empty('vesselname')} as vessel_name, {text_or_empty('imo')} as imo,
    {text_or_empty('mmsi')} as mmsi, {num('lat')} as latitude, {num('lon')} as longitude, {num('sog')} as speed,
    {num('heading')} as course, 'AIS' as feed, mmsi as raw_mmsi, sog as raw_sog, heading as raw_heading,
    vesselname as raw_vesselname, coalesce({checks}) as reject_reason from ais_u)"""


P8I_CSV_COLS = {"pos_date": "date", "pos_time": "time", "lat_dms": "lat", "lon_dms": "lon",
                "speed_kts": "speed", "course_deg": "course"}


def p8i_csv_ctes(src_sql: str | None = None) -> str:
    n = ", ".join(f"{na(c)} as {a}" for c, a in P8I_CSV_COLS.items())
    lat, lat_err = dms("lat")
    lon, lon_err = dms("lon")
    checks = ", ".join(["_ts_err", lat_err, lon_err, num_check("speed", "Speed Kts / Spare"),
                        num_check("course", "Course Deg / Bearing Deg")])
    return f"""{feed_cte('p8i_csv_raw')},
p8i_n as (select file_name, row_no, {n} from p8i_csv_raw),{j1_ctes('p8i_n', 'date', 'time', 'p8i_j')},
p8i as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    _ts as logged_timestamp, {lat} as latitude, {lon} as longitude, {num('speed')} as speed,
    {num('course')} as bearing, {num('course')} as course, 'P8I' as feed, coalesce({checks}) as reject_reason from p8i_j)"""


def dmas_ctes() -> str:
    def g(path):
        return f"(v ->> '{path}')"

    def num_err(name):
        x = g(name)
        return (f"(case when not coalesce({is_float(x)}, false) then 'Invalid number for {name}: ' "
                f"|| coalesce({x}, 'None') end)")

    def z(x):
        return f"(case when length({x}) < 2 then lpad({x}, 2, '0') else {x} end)"

    t = "$.struct_update_track_timestamp."
    dd = z(f"coalesce({g(t + 'date_dd')}, '00')")
    mm = z(f"coalesce({g(t + 'date_mm')}, '00')")
    yy = f"coalesce({g(t + 'date_yy')}, '0000')"
    hh = z(f"coalesce({g(t + 'time_hour')}, '00')")
    mi = z(f"coalesce({g(t + 'time_minute')}, '00')")
    ss = f"coalesce({g(t + 'time_second')}, '00')"
    trk = g("sys_trk_no")
    checks = ", ".join([
        "(case when not _valid then 'Invalid JSON' end)",
        "(case when _ts_err is not null then 'Invalid date format: ' || _md end)",
        num_err("latitude"), num_err("longitude"), num_err("speed"), num_err("bearing"), num_err("course"),
        f"(case when _trk is null then 'Invalid integer for sys_trk_no: ' || coalesce({trk}, 'None') end)",
    ])
    return f"""{feed_cte('dmas_ndjson')},
dmas_l as (select file_name, row_no, value, coalesce(json_valid(value) and regexp_matches(value, '^\\s*[{{]'), false) as _valid
    from dmas_ndjson where {strip("coalesce(value, '')")} <> ''),
dmas_v as (select *, (case when _valid then value else '{{}}' end) as v from dmas_l),
dmas_m as (select *, concat({dd}, '-', {mm}, '-', {yy}) as _md, concat({hh}, ':', {mi}, ':', {ss}) as _mt,
    (case when {is_int(trk)} then try_cast({trk} as integer) end) as _trk from dmas_v),{j1_ctes('dmas_m', '_md', '_mt', 'dmas_j')},
dmas as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    {num(g('latitude'))} as latitude, {num(g('longitude'))} as longitude, {num(g('speed'))} as speed,
    {num(g('bearing'))} as bearing, {num(g('course'))} as course, _ts as logged_timestamp, _trk as sys_trk_no,
    concat('POINT(', {g('longitude')}, ' ', {g('latitude')}, ')') as location, 'DMAS' as feed,
    coalesce({checks}) as reject_reason from dmas_j)"""


PIRACY_COLS = ["date", "time", "longitude", "latitude", "attack_type", "location_description", "nearest_country",
               "eez_country", "shore_distance", "shore_longitude", "shore_latitude", "attack_description",
               "vessel_name", "vessel_type", "vessel_status", "data_source"]


def piracy_ctes() -> str:
    n = ", ".join(f"{na(c)} as {c}" for c in PIRACY_COLS)
    checks = ", ".join(["_ts_err", num_check("latitude", "latitude"), num_check("longitude", "longitude")])
    return f"""{feed_cte('piracy_raw')},
pir_n as (select file_name, row_no, {n} from piracy_raw),{j1_ctes('pir_n', 'date', 'time', 'pir_j')},
piracy as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    _ts as logged_timestamp, {num('latitude')} as latitude, {num('longitude')} as longitude,
    {text_or_empty('vessel_name')} as vessel_name, 'Piracy' as feed, coalesce({checks}) as reject_reason from pir_j)"""


def pirate_attacks_sql() -> str:
    n = ", ".join(f"{na(c)} as {c}" for c in PIRACY_COLS)
    s = strip("date")
    day = (f"coalesce((case when regexp_matches({s}, '^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{4}}$') then try_strptime({s}, '%d-%m-%Y') end), "
           f"(case when regexp_matches({s}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then try_strptime({s}, '%d/%m/%Y') end), "
           f"(case when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') then try_strptime({s}, '%Y-%m-%d') end))")
    dbl = {"longitude", "latitude", "shore_distance", "shore_longitude", "shore_latitude"}
    out = ", ".join(num(c) + f" as {c}" if c in dbl else c for c in PIRACY_COLS[2:])
    return f"""with {feed_cte('piracy_raw')},
pir_n as (select file_name, row_no, {n} from piracy_raw),
pa as (select cast({day} as timestamp) as attack_datetime, {out} from pir_n)
select * from pa where attack_datetime is not null"""


TRACK_NUMS = ["latitude", "longitude", "altitude", "course", "bearing", "speed"]
TRACK_TEXT = ["msg_date", "msg_time", "change_type", "latitude", "longitude", "altitude", "course", "bearing", "speed",
              "position_valid_date_yyyymmdd", "position_valid_time", "trk_short_name", "sub_source_name"]


def tracking_ctes() -> str:
    n = ", ".join(f"{na(c)} as {c}" for c in TRACK_TEXT)
    md, e_md = strict_date("msg_date", "dmy")
    mt, e_mt = strict_time("msg_time")
    pvd, e_pvd = strict_date("position_valid_date_yyyymmdd", "ymd")
    pvt, e_pvt = strict_time("position_valid_time")
    nums = ", ".join(f"{num0(c)} as {c}" for c in TRACK_NUMS)
    checks = ", ".join([e_md, e_mt] + [num_check(c, c) for c in TRACK_NUMS] + [e_pvd, e_pvt])
    return f"""{feed_cte('p8i_tracking_raw')},
trk_n as (select file_name, row_no, {n} from p8i_tracking_raw),
tracking as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    cast({md} as varchar) as msg_date, {mt} as msg_time, change_type, {nums},
    cast({pvd} as varchar) as position_valid_date, {pvt} as position_valid_time, trk_short_name, sub_source_name,
    coalesce({checks}) as reject_reason from trk_n)"""


ESM_TEXT = ["msg_date", "msg_time", "emitter", "emitter_enumeration", "beam_enumeration", "change_type", "amplitude",
            "frequency", "position_valid_date_yyyymmdd", "position_valid_date", "position_valid_time",
            "azimuth_degree", "latitude", "longitude", "azimuth_accuracy_degree", "sub_source_name"]
ESM_NUMS = ["amplitude", "frequency", "azimuth_degree", "latitude", "longitude", "azimuth_accuracy_degree"]


def esm_ctes() -> str:
    n = ", ".join(f"{na(c)} as {c}" for c in ESM_TEXT)
    md, e_md = strict_date("msg_date", "dmy")
    mt, e_mt = strict_time("msg_time")
    ymd, e_ymd = strict_date("_pd", "ymd")
    dmy, e_dmy = strict_date("_pd", "dmy")
    pvt, e_pvt = strict_time("_pt")
    use_ymd = "(coalesce(position_valid_date_yyyymmdd, '') <> '')"
    nums = ", ".join(f"{num0(c)} as {c}" for c in ESM_NUMS)
    checks = ", ".join([
        "(case when _pd is null then 'Missing required field: Position Valid Date YYYYMMDD' end)",
        e_md, e_mt, num_check("amplitude", "amplitude"), num_check("frequency", "frequency"),
        f"(case when {use_ymd} then {e_ymd} else {e_dmy} end)", e_pvt,
    ] + [num_check(c, c) for c in ESM_NUMS[2:]])
    return f"""{feed_cte('p8i_esm_raw')},
esm_n as (select file_name, row_no, {n} from p8i_esm_raw),
esm_p as (select *, coalesce({blank_null('position_valid_date_yyyymmdd')}, {blank_null('position_valid_date')}) as _pd,
    {blank_null('position_valid_time')} as _pt from esm_n),
esm as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    cast({md} as varchar) as msg_date, {mt} as msg_time, emitter, emitter_enumeration, beam_enumeration, change_type,
    {nums}, cast((case when {use_ymd} then {ymd} else {dmy} end) as varchar) as "Position Valid Date YYYYMMDD",
    {pvt} as "Position Valid Time", cast(null as varchar) as last_beam_intercept_date,
    cast(null as varchar) as last_beam_intercept_time, sub_source_name,
    coalesce({checks}) as reject_reason from esm_p)"""


DIMS = f"""{feed_cte('source_dim')}, {feed_cte('sub_source_dim')}"""


def records_ctes() -> str:
    """All saved records of the five feeds (what lands in cdf_data)."""
    return f"""{ais_ctes()},
{p8i_csv_ctes()},
{dmas_ctes()},
{piracy_ctes()},
{tracking_ctes()},
{DIMS},
trk_rec as (select row_no, file_name, uuid, file_uuid, latitude, longitude, speed, bearing, course,
    cast(null as timestamp) as logged_timestamp, cast(null as integer) as sys_trk_no, cast(null as varchar) as location,
    cast(null as varchar) as vessel_name, cast(null as varchar) as imo, cast(null as varchar) as mmsi,
    sub_source_name, 'P8I' as feed, reject_reason from tracking
    where lower(coalesce(sub_source_name, '')) in ('redicent', 'efficnt', 'esmcnt', 'eoircnt', 'ardrcnt', 'esm emit beams', 'esm emitters')),
trk_generic as (select row_no, file_name, {uuid_of('file_name', 'row_no')} as uuid, {uuid_of('file_name')} as file_uuid,
    cast(null as double) as latitude, cast(null as double) as longitude, cast(null as double) as speed,
    cast(null as double) as bearing, cast(null as double) as course, cast(null as timestamp) as logged_timestamp,
    cast(null as integer) as sys_trk_no, cast(null as varchar) as location, cast(null as varchar) as vessel_name,
    cast(null as varchar) as imo, cast(null as varchar) as mmsi, sub_source_name, 'P8I' as feed,
    'Missing field: position valid time hh:mm:ss.sss' as reject_reason from p8i_tracking_raw
    where lower(coalesce(sub_source_name, '')) not in ('redicent', 'efficnt', 'esmcnt', 'eoircnt', 'ardrcnt', 'esm emit beams', 'esm emitters')),
all_conv as (
    select row_no, file_name, uuid, file_uuid, latitude, longitude, speed, cast(null as double) as bearing, course,
        logged_timestamp, cast(null as integer) as sys_trk_no, cast(null as varchar) as location, vessel_name, imo, mmsi,
        cast(null as varchar) as sub_source_name, feed, reject_reason from ais
    union all select row_no, file_name, uuid, file_uuid, latitude, longitude, speed, bearing, course, logged_timestamp,
        null, null, null, null, null, null, feed, reject_reason from p8i
    union all select row_no, file_name, uuid, file_uuid, latitude, longitude, speed, bearing, course, logged_timestamp,
        sys_trk_no, location, null, null, null, null, feed, reject_reason from dmas
    union all select row_no, file_name, uuid, file_uuid, latitude, longitude, null, null, null, logged_timestamp,
        null, null, vessel_name, null, null, null, feed, reject_reason from piracy
    union all select * from trk_rec
    union all select * from trk_generic),
src_key as (select lower(name) as k, min(id) as sid from source_dim group by lower(name)),
ss_key as (select name as k, min(id) as ssid from sub_source_dim group by name),
all_rec as (select c.*, cast(coalesce(s.sid, 1) as integer) as source_id,
    cast(coalesce(ss.ssid, (select min(id) from sub_source_dim), 1) as integer) as sub_source_id
    from all_conv c left join src_key s on lower(c.feed) = s.k left join ss_key ss on c.sub_source_name = ss.k)"""


def file_ctes() -> str:
    ext = r"lower(regexp_extract(filename, '^(?:.*/)?\.*[^/.][^/]*\.([^./]*)$', 1))"
    cat = ("(case when starts_with(content_type, 'image/') then 'image' when content_type = 'application/pdf' then 'pdf' "
           "when starts_with(content_type, 'video/') then 'video' when starts_with(content_type, 'audio/') then 'audio' "
           "when content_type in ('text/csv', 'application/vnd.ms-excel') then 'csv' "
           "when content_type = 'application/json' then 'json' end)")
    bucket = ("(case _cat when 'image' then 'images' when 'pdf' then 'pdf' when 'video' then 'videos' "
              "when 'audio' then 'audio' when 'csv' then 'csv' when 'json' then 'json' end)")
    return f"""{feed_cte('file_events')},
fe_c as (select *, {cat} as _cat, {ext} as _ext from file_events),
catalog as (select uuid, filename, timestamp, coalesce(_cat, _ext) as type,
    coalesce({bucket}, case when _ext <> '' then _ext || '-files' end, 'misc-files') as bucket,
    content_type, cast(size as bigint) as size, upload_source as source from fe_c)"""


def _with(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"


def _rejects(cte: str) -> str:
    return f"select row_no, file_uuid, reject_reason from {cte} where reject_reason is not null"


WORD_RE = NOT_WS + "+"

ORACLE: dict[str, str] = {}


def _build() -> None:
    o = ORACLE
    o["refined_speed"] = _with(ais_ctes(), "select latitude, longitude, speed from ais where reject_reason is null and speed > 10")
    o["ais_to_cdf"] = _with(ais_ctes(), "select row_no, uuid, file_uuid, logged_timestamp, vessel_name, imo, mmsi, "
                            "latitude, longitude, speed, course from ais where reject_reason is null")
    o["ais_rejects"] = _with(ais_ctes(), _rejects("ais"))
    o["raw_data_json"] = _with(ais_ctes(), "select row_no, raw_mmsi as mmsi, raw_sog as sog, raw_heading as heading, "
                               "raw_vesselname as vesselname from ais where reject_reason is null")
    o["p8i_csv_to_cdf"] = _with(p8i_csv_ctes(), "select row_no, uuid, logged_timestamp, latitude, longitude, speed, "
                                "bearing, course from p8i where reject_reason is null")
    o["p8i_csv_rejects"] = _with(p8i_csv_ctes(), _rejects("p8i"))
    o["dmas_to_cdf"] = _with(dmas_ctes(), "select row_no, uuid, latitude, longitude, speed, bearing, course, "
                             "logged_timestamp, sys_trk_no, location from dmas where reject_reason is null")
    o["dmas_rejects"] = _with(dmas_ctes(), _rejects("dmas"))
    o["piracy_to_cdf"] = _with(piracy_ctes(), "select row_no, uuid, logged_timestamp, latitude, longitude, vessel_name "
                               "from piracy where reject_reason is null")
    o["piracy_rejects"] = _with(piracy_ctes(), _rejects("piracy"))
    o["pirate_attacks_load"] = pirate_attacks_sql()
    o["p8i_tracking"] = _with(tracking_ctes(), "select row_no, uuid, file_uuid, msg_date, msg_time, change_type, latitude, "
                              "longitude, altitude, course, bearing, speed, position_valid_date, position_valid_time, "
                              "trk_short_name, sub_source_name from tracking where reject_reason is null")
    o["p8i_tracking_rejects"] = _with(tracking_ctes(), _rejects("tracking"))
    o["p8i_esm"] = _with(esm_ctes(), "select row_no, uuid, file_uuid, msg_date, msg_time, emitter, emitter_enumeration, "
                         "beam_enumeration, change_type, amplitude, frequency, \"Position Valid Date YYYYMMDD\", "
                         "\"Position Valid Time\", azimuth_degree, latitude, longitude, azimuth_accuracy_degree, "
                         "sub_source_name from esm where reject_reason is null")
    o["p8i_esm_rejects"] = _with(esm_ctes(), _rejects("esm"))
    route = ("(case when coalesce(sub_source_name, '') = '' then 'Missing ''sub_source_name'' in row.' "
             "when sub_source_name in ('Redicent', 'Efficnt', 'Esmcnt', 'Eoircnt', 'Ardrcnt') then 'p8i_tracking.tracking_data' "
             "when sub_source_name in ('Esm_emit beams', 'Esm emitters') then 'p8i_esm.esm_data' "
             "else 'Unknown sub_source: ' || sub_source_name end)")
    union = (f"{feed_cte('p8i_tracking_raw')}, {feed_cte('p8i_esm_raw')},\n"
             "p8i_all as (select 'tracking' as input, row_no, sub_source_name from p8i_tracking_raw "
             "union all select 'esm', row_no, sub_source_name from p8i_esm_raw)")
    o["p8i_route"] = _with(union, f"select input, row_no, sub_source_name, {route} as target from p8i_all")
    conv = ("(case when lower(coalesce(sub_source_name, '')) in ({names}) then 'tracking' else 'p8i_csv' end)")
    s_names = "'redicent', 'efficnt', 'esmcnt', 'eoircnt', 'ardrcnt', 'esm emit beams', 'esm emitters'"
    n_names = "'redicent', 'garud', 'globaleye', 'falcon', 'netra', 'sentinel', 'jstars', 'phalcon', 'heron', 'hera'"
    o["p8i_dispatch"] = _with(union, f"select input, row_no, sub_source_name, {conv.format(names=s_names)} as converter, "
                              f"{conv.format(names=n_names)} as converter_ndjson from p8i_all")
    o["feed_dispatch"] = _with(records_ctes(), "select uuid, feed, (case when reject_reason is null then 'saved' else "
                               "'failed' end) as status, (case when reject_reason is null then logged_timestamp end) as logged_timestamp, "
                               "(case when reject_reason is null then latitude end) as latitude, (case when reject_reason "
                               "is null then longitude end) as longitude, (case when reject_reason is null then speed end) "
                               "as speed from all_rec")
    export = ("select r.uuid, r.file_uuid, r.latitude, r.longitude, r.speed, r.bearing, r.course, r.sys_trk_no, "
              "s.name as source, ss.name as sub_source, (case when r.location is null then null "
              "when regexp_matches(r.location, '^POINT ?\\(\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s+"
              "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*\\)$') then r.location else 'Invalid geometry' end) "
              f"as location, {iso_text('r.logged_timestamp')} as logged_timestamp, r.vessel_name, r.imo, r.mmsi "
              "from all_rec r left join source_dim s on r.source_id = s.id "
              "left join sub_source_dim ss on r.sub_source_id = ss.id where r.reject_reason is null")
    o["cdf_export"] = _with(records_ctes(), export)
    o["cdf_by_file"] = _with(records_ctes(), "select uuid, row_no, feed, latitude, longitude, speed, logged_timestamp "
                             f"from all_rec where reject_reason is null and file_uuid = {uuid_of(q('ais_view.csv'))}")
    o["cdf_by_source_day"] = _with(
        records_ctes(), "select r.uuid, r.file_uuid, r.row_no, strftime(r.logged_timestamp, '%Y-%m-%d') as day, r.latitude, r.longitude, r.speed "
        "from all_rec r join source_dim s on r.source_id = s.id where r.reject_reason is null and lower(s.name) = 'ais' "
        "and cast(r.logged_timestamp as date) between date '2024-01-10' and date '2024-01-12'")
    o["upload_csv_multiline"] = (
        "select o_orderkey as incident, case o_orderkey % 4 when 0 then 'Berth ' || o_custkey "
        "when 1 then 'Berth ' || o_custkey || chr(10) || 'Dock \"' || o_orderpriority || '\", north' "
        "when 2 then chr(10) || 'a, b' || chr(10) || chr(10) || '\"\"' else '\"' || o_orderstatus end as location_description, "
        "case when o_orderkey % 71 = 0 then 'failed' else 'saved' end as status, "
        "'MV ' || o_custkey || case when o_orderkey % 5 = 0 then chr(10) || 'aft' else '' end as vessel_name, "
        "cast(o_orderkey % 180 - 90 as double) + 0.25 as latitude from orders")
    o["latest_objects_incremental"] = _with(
        file_ctes(), "select bucket, filename, timestamp, uuid from (select *, row_number() over "
        "(partition by bucket, filename order by timestamp desc, uuid desc) rn from catalog) where rn = 1")
    o["duplicate_uuids_incremental"] = _with(
        feed_cte("ais_raw") + ",\nuploads as (select unnest([0, 1, 2]) as upload),\n"
        "sent as (select u.upload, " + uuid_of("file_name", "row_no") + " as uuid from ais_raw, uploads u "
        "where row_no % 3 = u.upload or (u.upload > 0 and row_no % 3 = (u.upload + 2) % 3 and row_no % 17 = 0))",
        "select * from (select a.upload, a.uuid, count(*) as n from (select distinct upload, uuid from sent) a "
        "join sent b on a.uuid = b.uuid and b.upload <= a.upload group by a.upload, a.uuid) where n > 1")
    o["source_lookup"] = _with(records_ctes(), "select k.source_id, s.name from (select distinct source_id from all_rec "
                               "where reject_reason is null) k left join source_dim s on k.source_id = s.id")
    o["source_list"] = _with(records_ctes(), "select s.id, s.name, coalesce(c.n, 0) as record_count from source_dim s "
                             "left join (select source_id, count(*) as n from all_rec where reject_reason is null "
                             "group by source_id) c on s.id = c.source_id")
    upload_ids = (f"{feed_cte('file_events')}, {feed_cte('sub_source_dim')},\n"
                  "ids as (select distinct cast(upload_source as integer) as source_id from file_events "
                  "where regexp_matches(upload_source, '^[0-9]+$'))")
    o["sub_sources_of"] = _with(upload_ids, "select i.source_id, ss.id as sub_source_id, ss.name as sub_source_name "
                                "from ids i left join sub_source_dim ss on i.source_id = ss.source_id")
    o["upload_source_name"] = _with(
        f"{feed_cte('file_events')}, {feed_cte('source_dim')}",
        "select f.uuid, f.upload_source, (case when regexp_matches(f.upload_source, '^[0-9]+$') then "
        "coalesce(s.name, 'unknown') else f.upload_source end) as source_name from file_events f left join source_dim s "
        "on (case when regexp_matches(f.upload_source, '^[0-9]+$') then try_cast(f.upload_source as integer) end) = s.id")
    o["upload_summary"] = _with(records_ctes() + ",\ndm_att as (select file_name, count(*) as n from dmas_ndjson group by file_name)",
                                "select " + uuid_of("a.file_name") + " as file_uuid, a.file_name, a.feed, "
                                "cast(coalesce(d.n, a.cnt) as bigint) as attempted, a.saved, a.failed from ("
                                "select file_name, min(feed) as feed, count(*) as cnt, "
                                "cast(count(*) filter (where reject_reason is null) as bigint) as saved, "
                                "cast(count(*) filter (where reject_reason is not null) as bigint) as failed "
                                "from all_rec group by file_name) a left join dm_att d on a.file_name = d.file_name")
    o["upload_failures"] = _with(records_ctes(), "select " + uuid_of("file_name") + " as file_uuid, file_name, row_no, "
                                 "'Row ' || cast(row_no as varchar) || ' failed: ' || reject_reason as message "
                                 "from all_rec where reject_reason is not null")
    o["upload_metadata_list"] = _with(
        records_ctes(),
        "select a.file_name, s.name as source, ss.name as sub_source, upper(regexp_extract(a.file_name, '\\.([^./]+)$', 1)) "
        "as format, a.saved as record_count from (select file_name, min(source_id) as source_id, "
        "min(sub_source_id) as sub_source_id, cast(count(*) filter (where reject_reason is null) as bigint) as saved "
        "from all_rec group by file_name) a left join source_dim s on a.source_id = s.id "
        "left join sub_source_dim ss on a.sub_source_id = ss.id")
    o["duplicate_uuids"] = _with(records_ctes(), "select uuid, count(*) as n from all_rec where reject_reason is null "
                                 "group by uuid having count(*) > 1")
    o["fk_violations"] = _with(
        records_ctes() + ",\n" + file_ctes(),
        "select 'file_catalog.source' as relation, uuid as key, cast(source as integer) as value from catalog "
        "where regexp_matches(source, '^[0-9]+$') and cast(source as integer) not in (select id from source_dim) "
        "union all select 'sub_source.source_id', cast(id as varchar), source_id from sub_source_dim "
        "where source_id is not null and source_id not in (select id from source_dim) "
        "union all select 'cdf_data.source_id', uuid, source_id from all_rec where reject_reason is null "
        "and source_id is not null and source_id not in (select id from source_dim) "
        "union all select 'cdf_data.sub_source_id', uuid, sub_source_id from all_rec where reject_reason is null "
        "and sub_source_id is not null and sub_source_id not in (select id from sub_source_dim)")
    kind = ("(case when content_type in ('application/x-ndjson', 'application/json') or ends_with(lower(filename), '.ndjson') "
            "then 'ndjson' when content_type in ('text/csv', 'application/vnd.ms-excel', "
            "'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet') or ends_with(lower(filename), '.csv') "
            "or ends_with(lower(filename), '.tsv') or ends_with(lower(filename), '.xlsx') then 'structured' "
            "when starts_with(content_type, 'image/') or ends_with(lower(filename), '.jpg') or ends_with(lower(filename), '.jpeg') "
            "or ends_with(lower(filename), '.png') then 'image' when starts_with(content_type, 'audio/') "
            "or ends_with(lower(filename), '.mp3') or ends_with(lower(filename), '.wav') then 'audio' "
            "when content_type = 'application/pdf' or ends_with(lower(filename), '.pdf') then 'pdf' else 'unsupported' end)")
    o["file_kind"] = _with(feed_cte("file_events"), f"select uuid, filename, content_type, {kind} as kind from file_events")
    o["file_bucket"] = _with(file_ctes(), "select uuid, filename, content_type, type, bucket from catalog")
    o["file_history"] = _with(file_ctes(), "select * from catalog")
    o["latest_objects"] = _with(file_ctes(), "select bucket, filename, timestamp, uuid from (select *, row_number() over "
                                "(partition by bucket, filename order by timestamp desc, uuid desc) rn from catalog) where rn = 1")
    o["file_by_uuid"] = _with(
        file_ctes() + ",\ncur as (select bucket, filename, uuid as current_uuid from (select *, row_number() over "
        "(partition by bucket, filename order by timestamp desc, uuid desc) rn from catalog) where rn = 1)",
        "select c.uuid, c.bucket, c.filename, c.content_type, (k.current_uuid = c.uuid) as found, k.current_uuid "
        "from catalog c left join cur k on c.bucket = k.bucket and c.filename = k.filename")
    o["file_history_page"] = _with(file_ctes(), "select * from catalog where timestamp < '1996-07-01' or (timestamp = '1996-07-01' and uuid < 'f-9') "
                                   "order by timestamp desc, uuid desc limit 100")
    o["file_bytes"] = (
        "with f as (select o_orderkey // 1024 as k, string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || chr(10), '' order by o_orderkey) as a, "
        "string_agg(o_orderpriority || '|' || o_orderkey || chr(10), '' order by o_orderkey) as b from orders group by o_orderkey // 1024), "
        "g as (select k, case when k % 3 = 0 then b else a end as body from f where k % 2 = 0), "
        "c as (select k, body, unnest(range((length(body) + 4999) // 5000)) as chunk from g), "
        "p as (select *, substr(body, chunk * 5000 + 1, 5000) as piece from c) "
        "select 'u0-' || k as uuid, 'orders_' || k || '.csv' as filename, 'csv' as bucket, k % 3 <> 0 as found, "
        "case when k % 3 = 0 then 'u1-' else 'u0-' end || k as current_uuid, cast(length(body) as bigint) as size, "
        "cast(chunk as integer) as chunk, cast(length(piece) as integer) as n_bytes, sha256(piece) as sha256 from p")
    o["raw_data_fields"] = raw_data_fields_sql()
    o["file_size_mb"] = _with(file_ctes(), "select uuid, size, round(size / 1048576.0, 2) as size_mb from catalog")
    o["image_record"] = _with(feed_cte("exif_tags"), "select * exclude (has_cam) from (" + _image_record_sql() + ")")
    o["image_summary"] = _with(feed_cte("exif_tags") + ",\nrec as (" + _image_record_sql() + ")",
                               "select file_uuid, filename, has_gps, has_cam as has_camera_info, (coalesce(timestamp, '') <> '') as has_timestamp, timestamp, camera_make, "
                               "camera_model, coordinates as gps_coordinates from rec")
    o["text_profile"] = (
        "select doc_id, length(text) as text_length, len(regexp_extract_all(coalesce(text, ''), " + q(WORD_RE) + ")) as word_count, "
        "(case when length(fp) > 200 then concat(substr(fp, 1, 200), '...') else fp end) as first_paragraph from ("
        "select *, (case when " + strip("split_part(coalesce(text, ''), chr(10), 1)") + " <> '' then "
        "split_part(coalesce(text, ''), chr(10), 1) else split_part(coalesce(text, ''), chr(10), 2) end) as fp from documents)")


#: Cells of the piracy feed as they are named in a raw row.
PIRACY_COLS = ["date", "time", "longitude", "latitude", "attack_type", "location_description", "nearest_country", "eez_country",
               "shore_distance", "shore_longitude", "shore_latitude", "attack_description", "vessel_name", "vessel_type",
               "vessel_status", "data_source"]
#: Headers of a P8I CSV file, lower-cased, by the name that the feed gives them.
P8I_HEADERS = {"pos_date": "position valid date yyyymmdd", "pos_time": "position valid time hh:mm:ss.sss", "lat_dms": "lat / lat origin",
               "lon_dms": "long / long origin", "speed_kts": "speed kts / spare", "course_deg": "course deg / bearing deg"}


def raw_data_fields_sql() -> str:
    ais = {c: c.lower() for c in ("MMSI", "BaseDateTime", "LAT", "LON", "SOG", "Heading", "VesselName", "IMO")}
    tables = [("AIS", "ais_raw", "ais", ais), ("P8I", "p8i_csv_raw", "p8i", P8I_HEADERS),
              ("Piracy", "piracy_raw", "piracy", {c: c for c in PIRACY_COLS})]
    parts = []
    for feed, raw, converted, cols in tables:
        for c, key in cols.items():
            parts.append(f"select '{feed}' as feed, {q(key)} as key, {na('r.' + c)} as value, false as obj from {raw} r "
                         f"join {converted} c on r.file_name = c.file_name and r.row_no = c.row_no where c.reject_reason is null")
    parts.append("select 'DMAS' as feed, key, json_extract_string(value, '$.' || key) as value, json_type(value, '$.' || key) = 'OBJECT' as obj from "
                 "(select r.value, unnest(json_keys(r.value)) as key from dmas_ndjson r join dmas c on r.file_name = c.file_name "
                 "and r.row_no = c.row_no where c.reject_reason is null)")
    number = "(case when not obj and regexp_matches(value, '^[+-]?[0-9]+(\\.[0-9]+)?$') then try_cast(value as double) end)"
    return _with(
        f"{ais_ctes()},\n{p8i_csv_ctes()},\n{dmas_ctes()},\n{piracy_ctes()},\nfields as ({' union all '.join(parts)})",
        "select feed, key, count(*) as n, count(*) - count(value) as n_null, count(*) filter (where obj) as n_object, "
        "cast(sum(case when not obj then length(value) end) as bigint) as n_chars, "
        f"count({number}) as n_numbers, min({number}) as least, max({number}) as greatest from fields group by feed, key")


def _image_record_sql() -> str:
    def deg(v, r):
        p = f"string_split({strip(v)}, ' ')"
        ok = f"(len({p}) = 3 and {is_float(p + '[1]')} and {is_float(p + '[2]')} and {is_float(p + '[3]')})"
        d = f"(cast({p}[1] as double) + cast({p}[2] as double) / 60 + cast({p}[3] as double) / 3600)"
        return (f"(case when {v} is not null and {v} <> '' and {r} is not null and {r} <> '' and {ok} then "
                f"(case when {r} in ('N', 'E') then {d} else -{d} end) end)")

    dt = r"'^([0-9]{4}):([0-9]{1,2}):([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$'"
    parsed = f"(case when regexp_matches(dtv, {dt}) then try_strptime(dtv, '%Y:%m:%d %H:%M:%S') end)"
    return ("select file_uuid, filename, mk as camera_make, md as camera_model, lat as latitude, lon as longitude, "
            "(case when lat is not null and lon is not null then printf('%.6f, %.6f', lat, lon) end) as coordinates, "
            "has_gps, has_cam, coalesce(strftime(p, '%Y-%m-%dT%H:%M:%S') || 'Z', dtv) as timestamp, strftime(p, '%Y-%m-%d') as date_taken, "
            "strftime(p, '%H:%M:%S') as time_taken from (select *, " + parsed + " as p, "
            + deg("la", "lr") + " as lat, " + deg("lo", "lor") + " as lon from (select file_uuid, max(filename) as filename, "
            "max(case when tag = 'Make' then value end) as mk, max(case when tag = 'Model' then value end) as md, "
            "max(case when tag = 'GPSLatitude' then value end) as la, max(case when tag = 'GPSLatitudeRef' then value end) as lr, "
            "max(case when tag = 'GPSLongitude' then value end) as lo, max(case when tag = 'GPSLongitudeRef' then value end) as lor, "
            "coalesce(max(case when tag = 'DateTimeOriginal' then value end), max(case when tag = 'DateTime' then value end)) as dtv, "
            "bool_or(starts_with(tag, 'GPS')) as has_gps, bool_or(tag in ('Make', 'Model', 'Software', 'Artist', 'Copyright')) "
            "as has_cam from exif_tags group by file_uuid) w) g")


_build()
