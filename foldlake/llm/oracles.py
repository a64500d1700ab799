"""SQL (DuckDB) for the queries that SQL can express: mixing, secrets and preferences."""

from __future__ import annotations

from . import mixing, preferences, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mixing_sql(targets: mixing.Targets = mixing.DEFAULT) -> str:
    """Cells, raking as a recursion over rounds, and the draw."""
    counts = {name: f"len(regexp_extract_all(found, {_quoted(p)}))" for name, p in mixing.TOPICS.items()}
    topic = f"CASE WHEN most = 0 OR most * {mixing.DENSITY} < n_words THEN '{mixing.GENERAL}' " + " ".join(f"WHEN {c} = most THEN '{n}'" for n, c in counts.items()) + " END"
    named = lambda column, shares: f"CASE WHEN {column} IN ({', '.join(map(_quoted, shares))}) THEN {column} ELSE '{mixing.OTHER}' END"
    wanted = lambda column, shares: "CASE " + column + "".join(f" WHEN {_quoted(k)} THEN {'actual' if v is None else repr(v)}" for k, v in shares.items()) + " ELSE actual END"
    cap, floor, power = targets.source_cap, targets.source_floor, targets.source_power
    step = lambda inner, column, table: f"(SELECT it, s, l, t, share * wanted / sum(share) OVER (PARTITION BY {column}) AS share FROM ({inner}) JOIN {table} USING ({column}))"
    one = step(step(step("SELECT it, s, l, t, share FROM ipf", "s", "ws"), "l", "wl"), "t", "wt")
    return f"""
    WITH RECURSIVE d0 AS (SELECT doc_id, source, text, {named("lang", targets.lang)} AS l, array_to_string(regexp_extract_all(coalesce(text, ''), {_quoted(mixing.EVIDENCE)}), ' ') AS found,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words FROM documents),
    dt AS (SELECT *, {topic} AS topic FROM (SELECT *, greatest({", ".join(counts.values())}) AS most FROM d0)),
    d1 AS (SELECT *, {named("topic", targets.topic)} AS t FROM dt),
    large AS (SELECT source FROM d1 WHERE source IS NOT NULL GROUP BY source HAVING sum(n_words) > 0 AND sum(n_words) >= {floor} * (SELECT sum(n_words) FROM d1)),
    d AS (SELECT *, CASE WHEN source IN (SELECT source FROM large) THEN source ELSE '{mixing.OTHER}' END AS s FROM d1),
    cells AS (SELECT s, l, t, sum(n_words) AS n FROM d GROUP BY ALL),
    x AS (SELECT s, l, t, n::DOUBLE / (SELECT sum(n) FROM cells) AS share FROM cells WHERE n > 0),
    s0 AS (SELECT s, sum(share) AS share FROM x GROUP BY s),
    s1 AS (SELECT s, CASE WHEN s = '{mixing.OTHER}' THEN share ELSE share ** {power} / sum(share ** {power}) FILTER (s <> '{mixing.OTHER}') OVER () * sum(share) FILTER (s <> '{mixing.OTHER}') OVER () END AS w FROM s0),
    s2 AS (SELECT s, w, s = '{mixing.OTHER}' OR w < {cap} AS free FROM s1),
    s3 AS (SELECT s, CASE WHEN free THEN w * (1 + coalesce(sum(w - {cap}) FILTER (NOT free) OVER (), 0) / sum(w) FILTER (free) OVER ()) ELSE {cap} END AS w FROM s2),
    ws AS (SELECT s, w / sum(w) OVER () AS wanted FROM s3),
    wl AS (SELECT l, w / sum(w) OVER () AS wanted FROM (SELECT l, ({wanted("l", targets.lang)})::DOUBLE AS w FROM (SELECT l, sum(share) AS actual FROM x GROUP BY l))),
    wt AS (SELECT t, w / sum(w) OVER () AS wanted FROM (SELECT t, ({wanted("t", targets.topic)})::DOUBLE AS w FROM (SELECT t, sum(share) AS actual FROM x GROUP BY t))),
    ipf AS (SELECT 0 AS it, s, l, t, share FROM x UNION ALL SELECT it + 1, s, l, t, share FROM {one} WHERE it < {targets.rounds}),
    raked AS (SELECT s, l, t, share * (SELECT sum(n) FROM cells) / n AS weight FROM ipf JOIN cells USING (s, l, t) WHERE it = {targets.rounds}),
    f AS (SELECT s, l, t, coalesce(weight, (SELECT max(weight) FROM raked)) AS weight FROM cells LEFT JOIN raked USING (s, l, t))
    SELECT doc_id, s AS source, l AS lang, t AS topic, n_words, round(weight, 9) AS weight, round(weight / (SELECT max(weight) FROM raked), 9) AS probability,
        ('0x' || substr(md5('{targets.seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} < weight / (SELECT max(weight) FROM raked) AS sampled
    FROM d JOIN f USING (s, l, t)"""


def _spans_sql(kind: int) -> str:
    """(doc_id, text, start, kind, stop) of a kind's matches: lengths of the pieces between them,
    summed up."""
    pattern = _quoted(secrets.PATTERNS[kind])
    name = secrets.KINDS[kind]
    fits = {"assign": "len(v) >= 6", "mixed": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}.get(name, "true")
    value = f"regexp_extract_all(text, {pattern}, 2)" if name == "assign" else f"regexp_extract_all(text, {pattern})"
    return f"""SELECT rid, {kind} AS kind, stop - len(m) AS start, stop FROM (SELECT rid, m, v, sum(len(g) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS stop
        FROM (SELECT rid, unnest(regexp_split_to_array(text, {pattern})[:-2]) AS g, unnest(regexp_extract_all(text, {pattern})) AS m, unnest({value}) AS v, unnest(range(len(regexp_extract_all(text, {pattern})))) AS i
            FROM docs WHERE regexp_matches(text, {pattern}))) WHERE {fits}"""


def secrets_sql(scope: int = secrets.SCOPE) -> str:
    kinds = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(secrets.KINDS))
    parts = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(secrets.PART))
    needs = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(secrets.NEEDS))
    listed = f"string_agg(CASE kind {kinds} END || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({" UNION ALL ".join(_spans_sql(k) for k in range(len(secrets.KINDS)))}),
    hit AS (SELECT * FROM s WHERE kind < {secrets.STRONG} OR EXISTS (SELECT 1 FROM s p WHERE p.rid = s.rid AND (CASE s.kind {needs} END & CASE p.kind {parts} END) <> 0
        AND p.start < s.stop + {scope} AND p.stop > s.start - {scope} AND (p.stop <= s.start OR p.start >= s.stop))),
    g AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, coalesce({listed} FILTER (kind < {secrets.STRONG}), '') AS base, {listed} AS spans FROM hit GROUP BY rid)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN g USING (rid)"""


def preferences_sql() -> str:
    p = preferences
    nl = lambda text: "'" + text.replace("\n", "' || chr(10) || '") + "'"
    section = lambda s, what: f"coalesce(max({what}) FILTER (section = '{s}'), {'0' if what == 'n' else chr(39) * 2})"
    return f"""
    WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    r AS (SELECT *, turn * 1000000 + row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) AS place FROM t),
    sides AS (SELECT pair_id, side, turn, list(role || chr(0) || text ORDER BY role, text) AS said FROM t GROUP BY ALL),
    same AS (SELECT pair_id, turn, count(*) AS n, count(DISTINCT said) AS kinds FROM sides GROUP BY ALL),
    ends AS (SELECT pair_id, min(turn) FILTER (n < 2 OR kinds > 1) AS e FROM same GROUP BY 1),
    seg AS (SELECT pair_id, CASE WHEN e IS NULL OR turn < e THEN 'prompt' ELSE side END AS section, place, {nl(p.OPEN)} || role || {nl(p.CLOSE)} || text || {nl(p.END)} AS rendered,
        CASE WHEN role = 'assistant' AND NOT (e IS NULL OR turn < e) THEN length(text) + {len(p.END)} ELSE 0 END AS says FROM r JOIN ends USING (pair_id) WHERE NOT (e IS NULL OR turn < e) OR side = 'chosen'),
    o AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, section ORDER BY place) AS stop FROM seg),
    j AS (SELECT pair_id, section, count(*) AS n, string_agg(rendered, '' ORDER BY place) AS body, coalesce(string_agg((stop - says) || ':' || stop, ',' ORDER BY place) FILTER (says > 0), '') AS mask FROM o GROUP BY 1, 2)
    SELECT pair_id, {", ".join(f"{section(s, 'n')} AS n_{s}, {section(s, 'body')} AS {s}" for s in ("prompt", "chosen", "rejected"))}, {section("chosen", "mask")} AS chosen_mask, {section("rejected", "mask")} AS rejected_mask FROM j GROUP BY pair_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql(), "op4_secrets": secrets_sql(), "op7_preferences": preferences_sql()}
