"""Pieces of ANSI SQL (DuckDB) shared by the oracle statements."""


def _octets(x: str) -> str:
    return " || '.' || ".join(f"cast(cast(split_part({x}, '.', {i}) as int) as varchar)" for i in (1, 2, 3, 4))


def ip_map(sources: list[tuple[str, str]]) -> str:
    """CTE body: raw, host for all spellings in the given (table, column) pairs."""
    raw = " union ".join(f"select distinct {c} as raw from {t} where {c} is not null" for t, c in sources)
    count = "case when {0} = '' then 0 else length({0}) - length(replace({0}, ':', '')) + 1 end"
    pads = " || ':' || ".join(f"lpad(split_part(w, ':', {i}), 4, '0')" for i in range(1, 9))
    hexes = " || '.' || ".join(f"cast(cast('0x' || substr(g, {i}, 2) as int) as varchar)" for i in (31, 33, 36, 38))
    tail = "lower(to_hex(cast(split_part({0}, '.', {1}) as int) * 256 + cast(split_part({0}, '.', {2}) as int)))"
    last = "regexp_extract(x, '[^:]*$')"
    return f"""
      select raw, case when g is null then {_octets("x")} when g like '0000:0000:0000:0000:0000:ffff:%' then {hexes} else g end as host from (
      select raw, x, case when w is not null then {pads} end as g from (
      select raw, x, case when strpos(y, ':') = 0 then null when strpos(y, '::') = 0 then y else trim(both ':' from l || repeat(':0', 8 - {count.format("l")} - {count.format("r")}) || ':' || r) end as w from (
      select raw, x, y, split_part(y, '::', 1) as l, split_part(y, '::', 2) as r from (
      select raw, x, case when strpos(x, ':') > 0 and strpos(x, '.') > 0 then regexp_extract(x, '^(.*:)[^:]*$', 1) || {tail.format(last, 1, 2)} || ':' || {tail.format(last, 3, 4)} else x end as y from (
      select raw, lower(trim(raw)) as x from ({raw})))))) """


def path(c: str) -> str:
    """Canonical capture path of a column, for the spellings in the test tables."""
    x = f"regexp_replace({c}, '^file://', '')"
    x = f"case when {c} like 'file:%' then url_decode({x}) else {c} end"
    x = f"regexp_replace({x}, '/(\\./)+', '/', 'g')"
    x = f"regexp_replace({x}, '/+', '/', 'g')"
    return f"regexp_replace({x}, '/[^/]+/\\.\\./', '/', 'g')"
