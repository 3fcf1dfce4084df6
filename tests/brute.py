"""Plain, slow versions of the general problems over pandas frames, to hold the operators against."""

from __future__ import annotations

import ast
import json
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd

ABBR = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420}
LO, HI = datetime(2021, 1, 1, tzinfo=UTC), datetime(2026, 1, 1, tzinfo=UTC)
MON = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def read(d, name):
    return pd.read_parquet(f"{d}/{name}.parquet")


def local_ms(y, mo, day, h, mi, s, ns, zone):
    try:
        t = datetime(y, mo, day, h, mi, s)
    except ValueError:
        return None
    base = int((t - datetime(1970, 1, 1)).total_seconds()) * 1000 + (ns + 500000) // 1000000
    if isinstance(zone, int):
        return base - zone * 60000
    z = ZoneInfo(zone)
    # fold=0: the first of two, and beyond a gap by its length.
    return base - int(t.replace(tzinfo=z, fold=0).utcoffset().total_seconds()) * 1000


def ok(ms):
    return ms if ms is not None and LO.timestamp() * 1000 <= ms < HI.timestamp() * 1000 else None


def number(x, zone):
    """(instant, layout) of a count or of digits."""
    if x is None or x != x or x <= 0:
        return None, None
    n = len(str(int(x)))
    if n == 5:
        return ok(int((x - 25569) * 86400000 + 0.5)), "serial"
    if n in (12, 14):
        s = str(int(x))
        return ok(local_ms(int(s[:4]), int(s[4:6]), int(s[6:8]), int(s[8:10]), int(s[10:12]), int(s[12:] or 0), 0, zone)), "digits"
    scale = {10: 1000, 13: 1, 16: 1e-3, 19: 1e-6}.get(n)
    return (ok(int(x * scale + 0.5)) if n != 19 else ok((int(x) + 500000) // 1000000), n) if scale else (None, None)


def text(v):
    if v is None or v != v:
        return None
    s = v.replace("\xa0", " ").strip()
    if re.fullmatch(r"\d{8}", s):
        return ok(local_ms(int(s[:4]), int(s[4:6]), int(s[6:]), 23, 59, 59, 999000000, 0))
    if re.fullmatch(r"\d{9,}(\.\d+)?", s):
        return number(float(s) if "." in s else int(s), 0)[0]
    zone, rest = 0, s
    if m := re.fullmatch(r"([A-Z]\w+/\w+) (\S+ \S+)", s):
        zone, rest = m[1], m[2]
    elif m := re.fullmatch(r"(.*?)(?:\[(\w+/\w+)\]| (\w+/\w+))", s):
        zone, rest = m[2] or m[3], m[1]
    elif (m := re.fullmatch(r"(.*(?:\d| [AP]M)) ?([A-Za-z]{3,4}|[Zz])", s)) and m[2].upper() in ABBR:
        zone, rest = ABBR[m[2].upper()], m[1]
    elif m := re.fullmatch(r"(.*:\d\d(?:[.,]\d+)?(?: [AP]M)?) ?([+-])(\d\d):?(\d\d)?", s):
        zone, rest = (1 if m[2] == "+" else -1) * (int(m[3]) * 60 + int(m[4] or 0)), m[1]
    ns = 0
    if m := re.fullmatch(r"(.*:\d\d)[.,](\d+)", rest):
        rest, ns = m[1], int(m[2].ljust(9, "0"))
    rest = re.sub(r"^[A-Z][a-z]{2}, ", "", rest).replace("t", "T") if rest[:1].isdigit() else re.sub(r"^[A-Z][a-z]{2}, (?=\d\d [A-Z])", "", rest)
    for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y%m%dT%H%M%S", "%Y/%m/%d %H:%M:%S", "%d.%m.%Y %H:%M", "%d %b %Y %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%b %d, %Y %I:%M:%S %p"):
        try:
            t = datetime.strptime(rest, f)
        except ValueError:
            continue
        return ok(local_ms(t.year, t.month, t.day, t.hour, t.minute, t.second, ns, zone))
    for f in ("%Y-%m-%d", "%d.%m.%Y"):
        try:
            t = datetime.strptime(rest, f)
        except ValueError:
            continue
        return ok(local_ms(t.year, t.month, t.day, 23, 59, 59, 999000000, zone))
    return None


def zones(d):
    t = read(d, "tournaments").sort_values("ingested_at").drop_duplicates("tournament_id", keep="last")
    return {k: z or "UTC" for k, z in zip(t.tournament_id, t.settings_timezone, strict=True)}


def p6(d):
    out = set()
    t = read(d, "tournaments")
    for k, v, z in zip(t.tournament_id, t.start_time_ms.astype(object), t.settings_timezone, strict=True):
        ms, how = number(None if v is pd.NA or v != v else int(v), z or "UTC")
        if ms is not None and how != 13:
            out.add(("tournaments.start_time_ms", k, ms))
    for k, ms, how in ends(d):
        if ms is not None and how != 10:
            out.add(("matches.last_game_finished_at", k, ms))
    p = read(d, "players")
    for k, v in zip(p.player_id, p.created_at, strict=True):
        if v is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3}|\.\d{6})?Z", v) and (ms := text(v)) is not None:
            out.add(("players.created_at", k, ms))
    return out


def ends(d):
    z, m = zones(d), read(d, "matches")
    return [(k, *number(v, z.get(t, "UTC"))) for k, t, v in zip(m.match_id, m.tournament_id, m.last_game_finished_at, strict=True)]


def p1(d):
    end = {}
    for k, ms, _ in ends(d):
        if ms is not None:
            end[k] = max(end.get(k, 0), ms)
    t, a = read(d, "tournaments"), read(d, "player_appearances")
    org = {}
    for k, o in zip(t.tournament_id, t.org_slug, strict=True):
        if o is not None:
            org.setdefault(k, set()).add(o)
    got = {}
    for t_, m, p in zip(a.tournament_id, a.match_id, a.player_id, strict=True):
        if m in end and p == p:
            for o in org.get(t_, ()):
                got.setdefault((int(p), o), set()).add(m)
    return {k for k, ms in got.items() if len(ms) >= 4 and max(end[m] for m in ms) < 1735776000000}


def p3(d):
    t = {n: read(d, n) for n in ("matches", "player_appearances", "tournaments", "tournament_teams", "removed_records")}
    gone = {e: set(g.internal_id) for e, g in t["removed_records"].groupby("entity_type")}
    out = set()
    for name, child, rec, col, parent, key, e in (
        ("matches.winner_team_id", "matches", "match_id", "winner_team_id", "tournament_teams", "team_id", "team"),
        ("player_appearances.tournament_id", "player_appearances", "appearance_id", "tournament_id", "tournaments", "tournament_id", "tournament"),
        ("player_appearances.match_id", "player_appearances", "appearance_id", "match_id", "matches", "match_id", "match"),
    ):
        first = t[parent].groupby(key).ingested_at.min()
        r = t[child].dropna(subset=[col]).groupby([rec, col]).ingested_at.min().reset_index()
        for k, v, s in zip(r[rec], r[col], r.ingested_at, strict=True):
            if v not in first.index:
                out.add((name, k, "deleted" if v in gone.get(e, ()) else "missing"))
            elif s < first[v]:
                out.add((name, k, "late"))
    return out


def _read(s):
    s = s.strip("\ufeff \n\r\t")
    try:
        return json.loads(s)
    except ValueError:
        try:
            return ast.literal_eval(s)
        except (ValueError, SyntaxError):
            return None


def _norm(v):
    v = v.strip("\ufeff \n") if isinstance(v, str) else v
    if isinstance(v, str) and v and v[0] in "[{\"":
        return _norm(_read(v))
    if isinstance(v, dict):
        return {k.replace("_", "").lower(): _norm(x) for k, x in v.items()}
    return [_norm(x) for x in v] if isinstance(v, list) else v


def _list(v):
    return enumerate(v if isinstance(v, list) else [] if v is None else [v])


def p4(d):
    out = set()
    for origin, tab, key, col, names in (("tournaments.meta", "tournaments", "tournament_id", "meta", ("bracketprogression", "sources", "placements")), ("stages.settings", "stages", "stage_id", "settings", ("groups", "rounds", "maps"))):
        df = read(d, tab)
        for k, s in zip(df[key], df[col], strict=True):
            v = _norm(s) if s and s.strip("\ufeff \n")[:1] in "{[\"" else None
            while isinstance(v, dict) and names[0] not in v:
                v = next((v[w] for w in ("data", "payload", "result") if w in v), None)
            for i, a in _list(v.get(names[0]) if isinstance(v, dict) else None):
                for j, b in _list((a or {}).get(names[1])):
                    for n, c in _list((b or {}).get(names[2])):
                        if c is not None:
                            out.add((origin, k, i, j, n, str(c) if tab == "tournaments" else c.get("mode")))
    return out
