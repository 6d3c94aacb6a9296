"""Longer SQL that registered queries are held against."""

from __future__ import annotations

from .functions import numbers, text


def lcs(pairs: str) -> str:
    """CTE ``lcs`` of ``x, y, n``: the longest common subsequence of each pair of texts of ``pairs``, a row of the usual table a step."""
    return f"""
    steps AS (
        SELECT x, y, 0 AS k, list_transform(range(length(y) + 1), lambda i: 0) AS cells FROM (SELECT DISTINCT x, y FROM {pairs})
        UNION ALL
        SELECT x, y, k + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(cells[i], CASE WHEN i > 1 AND substr(x, k + 1, 1) = substr(y, CAST(i - 1 AS BIGINT), 1) THEN cells[i - 1] + 1 ELSE 0 END))))
        FROM steps WHERE k < length(x)
    ),
    lcs AS (SELECT x, y, CAST(cells[length(y) + 1] AS DOUBLE) AS n FROM steps WHERE k = length(x))"""


def taken(ranked: str) -> str:
    """CTE ``taken`` of ``l, r``: the rows of ``ranked`` (``k, l, r``; k from 1) taken in order, each end once."""
    return f"""
    walk AS (
        SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs
        UNION ALL
        SELECT w.k + 1, CASE WHEN used THEN ls ELSE list_append(ls, l) END, CASE WHEN used THEN rs ELSE list_append(rs, r) END
        FROM (SELECT w.k, ls, rs, p.l, p.r, list_contains(ls, p.l) OR list_contains(rs, p.r) AS used FROM walk w JOIN {ranked} p ON p.k = w.k + 1) w
    ),
    taken AS (SELECT unnest(ls) AS l, unnest(rs) AS r FROM walk WHERE k = (SELECT max(k) FROM walk))"""


_SORTED = "array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda w: w <> '')), ' ')"

_NAMES = f"""
    names AS (SELECT DISTINCT p_name AS a, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS b FROM part WHERE p_name IS NOT NULL),
    texts AS (SELECT l.a, r.b, {_SORTED.format(c="l.a")} AS x, {_SORTED.format(c="r.b")} AS y FROM names l, names r)"""

FUZZY_TOKENSORT = f"""
    WITH RECURSIVE {_NAMES}, {lcs("texts")}
    SELECT a, b, round(200 * n / (length(x) + length(y)), 4) AS similarity FROM texts JOIN lcs USING (x, y) WHERE 200 * n / (length(x) + length(y)) >= 80
"""

GREEDY_ASSIGN = f"""
    WITH RECURSIVE {_NAMES}, exact AS (SELECT a FROM names WHERE a IN (SELECT b FROM names)),
    open AS (SELECT * FROM texts WHERE a NOT IN (SELECT a FROM exact) AND b NOT IN (SELECT a FROM exact)), {lcs("open")},
    scores AS (SELECT a AS l, b AS r, 2 * n / (length(x) + length(y)) AS s FROM open JOIN lcs USING (x, y)),
    ranked AS (SELECT row_number() OVER (ORDER BY round(s, 4) DESC, l, r) AS k, l, r, round(s, 4) AS confidence, CAST(CAST(round_even(s * 100, 0) AS INTEGER) AS VARCHAR) AS shown FROM scores WHERE s >= 0.7),
    {taken("ranked")}
    SELECT a AS left_key, a AS right_key, 'exact' AS match_type, CAST(1.0 AS DOUBLE) AS confidence, 'Exact composite-key match.' AS explanation FROM exact
    UNION ALL SELECT l, r, 'fuzzy', confidence, 'Matched on fuzzy key ' || shown || '% (confidence ' || shown || '%).' FROM ranked JOIN taken USING (l, r)
"""


def suggested(left: tuple, right: tuple, money: str, identity: str, concepts: dict[str, str], threshold: float) -> str:
    """Fields suggested for two tables, each ``table, key, {column: (shown name, is a number)}``."""

    def side(tag: str, t: str, key: str, columns: dict[str, tuple[str, bool]]) -> tuple[str, str]:
        described, values = [], []
        for i, (c, (name, number)) in enumerate(columns.items()):
            shown = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if number else f"lower(trim({c}))"
            described.append(f"SELECT '{tag}' AS side, {i} AS place_at, '{name}' AS name, CAST(count(DISTINCT {shown}) AS DOUBLE) / count({c}) AS uniq, {'true' if number else 'false'} AS number FROM {t}")
            values.append(f"SELECT DISTINCT '{tag}' AS side, {i} AS place_at, {shown} AS v FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 2000)")
        return " UNION ALL ".join(described), " UNION ALL ".join(values)

    sides = [side("l", *left), side("r", *right)]
    words = ", ".join(f"('{w}', '{c}')" for w, c in concepts.items())
    return f"""
    WITH RECURSIVE raw AS ({" UNION ALL ".join(s[0] for s in sides)}), vals AS ({" UNION ALL ".join(s[1] for s in sides)}), words(word, concept) AS (VALUES {words}),
    kinds AS (SELECT *, CASE WHEN number THEN CASE WHEN regexp_matches(lower(name), '{money}') THEN 'money' ELSE 'numeric' END ELSE 'text' END AS dtype, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS tokens FROM raw),
    cols AS (SELECT *, greatest(0, 0.5 * uniq + CASE WHEN regexp_matches(lower(name), '{identity}') THEN 0.35 ELSE 0 END - CASE WHEN dtype = 'money' THEN 0.6 ELSE 0 END) >= 0.6 AS is_key, array_to_string(list_sort(tokens), ' ') AS sorted_name FROM kinds),
    said AS (SELECT side, place_at, pos, concept FROM (SELECT side, place_at, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM cols) JOIN words USING (word)),
    pairs AS (SELECT l.place_at AS la, r.place_at AS ra, l.name AS ln, r.name AS rn, l.sorted_name AS x, r.sorted_name AS y, l.uniq, l.is_key OR r.is_key AS either_key, array_to_string(l.tokens, '_') AS slug, CASE WHEN l.dtype = r.dtype THEN l.dtype ELSE 'money' END AS dtype
              FROM cols l, cols r WHERE l.side = 'l' AND r.side = 'r' AND l.number = r.number),
    {lcs("pairs")},
    sizes AS (SELECT side, place_at, count(*) AS n FROM vals GROUP BY 1, 2), shared AS (SELECT a.place_at AS la, b.place_at AS ra, count(*) AS n FROM vals a JOIN vals b USING (v) WHERE a.side = 'l' AND b.side = 'r' GROUP BY 1, 2),
    scored AS (SELECT p.*, 0.30 * (2 * lcs.n / (length(x) + length(y))) + 0.30 * CASE WHEN EXISTS (SELECT 1 FROM said a JOIN said b USING (concept) WHERE a.side = 'l' AND b.side = 'r' AND a.place_at = p.la AND b.place_at = p.ra) THEN 1 ELSE 0 END
                      + 0.55 * coalesce(CAST(s.n AS DOUBLE) / (sl.n + sr.n - s.n), 0) AS score
               FROM pairs p JOIN lcs USING (x, y) LEFT JOIN shared s ON s.la = p.la AND s.ra = p.ra LEFT JOIN sizes sl ON sl.side = 'l' AND sl.place_at = p.la LEFT JOIN sizes sr ON sr.side = 'r' AND sr.place_at = p.ra),
    ranked AS (SELECT row_number() OVER (ORDER BY score DESC, la, ra) AS k, ln AS l, rn AS r, * FROM scored WHERE score >= {threshold}),
    {taken("ranked")},
    named AS (SELECT p.*, row_number() OVER (ORDER BY k) AS place, coalesce((SELECT concept FROM said WHERE side = 'l' AND place_at = la ORDER BY pos LIMIT 1), (SELECT concept FROM said WHERE side = 'r' AND place_at = ra ORDER BY pos LIMIT 1), slug) AS base, either_key AND dtype <> 'money' AS key FROM ranked p JOIN taken USING (l, r)),
    final AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY place) - 1 AS again, NOT (SELECT bool_or(key) FROM named) AND place = (SELECT place FROM named ORDER BY uniq DESC, place LIMIT 1) AS forced FROM named)
    SELECT CASE WHEN again > 0 THEN base || '_' || again ELSE base END AS name, CASE WHEN key OR forced THEN 'key' ELSE 'value' END AS role, CASE WHEN forced AND dtype = 'money' THEN 'text' ELSE dtype END AS dtype, ln AS left_source, rn AS right_source, CASE WHEN dtype = 'text' THEN 'first' ELSE 'sum' END AS agg FROM final
    """


#: White space in Unicode's sense, as a text of SQL.
_WHITE = " || ".join(f"chr({ord(x)})" for x in text.WHITE)

TEXT_LINES = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text LIKE '% | %'),
    k AS (SELECT * FROM l WHERE trim(line, _WHITE_) <> '' AND NOT regexp_full_match(line, '[\s\x{0B}|+=\-_:]+')), f AS (SELECT doc_id, arg_min(line, n) AS first FROM k GROUP BY 1)""".replace("_WHITE_", _WHITE)

REGIONS_AND_HEADERS = (
    "WITH "
    + TEXT_LINES
    + r""",
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS r, CASE WHEN contains(first, '|') THEN string_split(regexp_replace(regexp_replace(trim(line, ' '), '^\|+', ''), '\|+$', ''), '|') WHEN contains(first, chr(9)) THEN string_split(line, chr(9)) ELSE string_split_regex(trim(line, ' '), '\s{2,}') END AS parts FROM k JOIN f USING (doc_id)),
    t0 AS (SELECT doc_id, r, c, trim(t, _WHITE_) AS t FROM (SELECT doc_id, r, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS c FROM p) WHERE trim(t, _WHITE_) <> ''),
    t1 AS (SELECT *, translate(t, _FROM_, _TO_) AS bare FROM t0),
    t2 AS (SELECT *, CASE WHEN NOT contains(bare, ',') THEN bare WHEN regexp_matches(bare, '_COMMAS_') THEN replace(bare, ',', '') ELSE replace(replace(bare, '.', ''), ',', '.') END AS one FROM t1),
    t3 AS (SELECT *, CASE WHEN regexp_matches(one, '_NUMBER_') AND (NOT contains(t, '(') OR starts_with(t, '(') AND ends_with(t, ')')) THEN TRY_CAST(translate(one, '~^%+', '') AS DECIMAL(36,12)) END AS v FROM t2),
    c0 AS (SELECT doc_id, r, t, c, v IS NOT NULL AND (contains(t, '%') OR TRY_CAST(v AS DECIMAL(28,6)) IS NOT NULL) AS num FROM t3),
    r0 AS (SELECT doc_id, r, count(*) AS n, count(*) FILTER (num) AS nums FROM c0 GROUP BY 1, 2),
    r1 AS (SELECT doc_id, r, sum(opens) OVER (PARTITION BY doc_id ORDER BY r) AS block FROM (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY doc_id ORDER BY r) > 1 AND n >= 2 AND nums / n < 0.34 THEN 1 ELSE 0 END AS opens FROM r0)),
    c1 AS (SELECT c0.*, block FROM c0 JOIN r1 USING (doc_id, r)),
    k1 AS (SELECT doc_id, block, c, sum(opens) OVER (PARTITION BY doc_id, block ORDER BY c) AS part FROM (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id, block ORDER BY c) > 1 THEN 1 ELSE 0 END AS opens FROM (SELECT DISTINCT doc_id, block, c FROM c1))),
    c2 AS (SELECT c1.*, part FROM c1 JOIN k1 USING (doc_id, block, c)),
    c3 AS (SELECT doc_id, block, part, t, num, dense_rank() OVER (PARTITION BY doc_id, block, part ORDER BY r) - 1 AS r, dense_rank() OVER (PARTITION BY doc_id, block, part ORDER BY c) - 1 AS c FROM c2),
    c4 AS (SELECT * FROM (SELECT *, max(r) OVER (PARTITION BY doc_id, block, part) + 1 AS n_rows, max(c) OVER (PARTITION BY doc_id, block, part) + 1 AS n_cols FROM c3) WHERE n_rows >= 2 AND n_cols >= 2),
    cells AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY block, part) AS region FROM c4),
    lines AS (SELECT doc_id, region, r, any_value(n_rows) AS n_rows, any_value(n_cols) AS n_cols, count(*) AS n, avg(CAST(num AS INTEGER)) AS num, count(DISTINCT lower(t)) / count(*) AS uniq, count(*) FILTER (c = 0) AS firsts FROM cells GROUP BY 1, 2, 3),
    scores AS (SELECT *, CASE WHEN n >= 2 AND r < greatest(least(25, n_rows - 1), 1) THEN n / n_cols + 1.2 * (1 - num) + uniq - num + 0.8 * (avg(n / n_cols) OVER w + 0.6 * avg(num) OVER w) END AS score FROM lines WINDOW w AS (PARTITION BY doc_id, region ORDER BY r ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)),
    best AS (SELECT doc_id, region, coalesce(first(r ORDER BY round(score, 9) DESC, r) FILTER (score IS NOT NULL), 0) AS top FROM scores GROUP BY 1, 2),
    tiers AS (SELECT s.doc_id, s.region, min(CASE WHEN firsts = 0 AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id, s.region ORDER BY r) AS ok FROM scores s JOIN best b USING (doc_id, region) WHERE r > top AND r <= top + 3 AND r < n_rows - 1),
    found AS (SELECT doc_id, region, top, top + coalesce((SELECT sum(ok) FROM tiers t WHERE t.doc_id = b.doc_id AND t.region = b.region), 0) AS last FROM best b),
    said AS (SELECT doc_id, region, c, string_agg(t, ' ' ORDER BY r) AS name FROM (SELECT doc_id, region, c, t, min(r) AS r FROM cells JOIN found USING (doc_id, region) WHERE r >= top AND r <= last GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
    names AS (SELECT doc_id, region, c, coalesce(name, 'col_' || c) AS name, row_number() OVER (PARTITION BY doc_id, region, coalesce(name, 'col_' || c) ORDER BY c) - 1 AS again FROM (SELECT DISTINCT doc_id, region, c FROM cells) LEFT JOIN said USING (doc_id, region, c)),
    heads AS (SELECT doc_id, region, string_agg(CASE WHEN again > 0 THEN name || '_' || again ELSE name END, ' / ' ORDER BY c) AS header FROM names GROUP BY 1, 2),
    body AS (SELECT doc_id, region, count(DISTINCT r) AS n_records FROM cells JOIN found USING (doc_id, region) WHERE r > last GROUP BY 1, 2),
    several AS (SELECT doc_id, max(region) > 1 AS many FROM cells GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN many THEN 'txt#' || region ELSE 'txt' END AS table_name, header, n_records FROM body JOIN heads USING (doc_id, region) JOIN several USING (doc_id)
    """
    .replace("_FROM_", f"'{numbers._DIGITS}()~^{numbers.CURRENCY_SYMBOLS} _'")
    .replace("_TO_", f"'{'0123456789' * 3}~^xx'")
    .replace("_COMMAS_", numbers._COMMAS_GO)
    .replace("_NUMBER_", numbers._NUMBER)
    .replace("_WHITE_", _WHITE)
)


def match_strategies(asked: dict, settings) -> str:
    """Accepted pairs of part names and reversed names by fuzzy, semantic and numeric scores, weighed as ``settings`` say."""
    f, s, n = settings.weight_fuzzy, settings.weight_semantic, settings.weight_numeric
    return f"""
    WITH RECURSIVE base AS (SELECT p_name AS a, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS b, CASE WHEN length(p_name) % 5 <> 0 THEN CAST(avg(CAST(p_retailprice AS DECIMAL(28,2))) AS DOUBLE) END AS price FROM part WHERE p_name IS NOT NULL GROUP BY 1),
    texts AS (SELECT l.a, r.b, l.price AS p, r.price AS q, {_SORTED.format(c="l.a")} AS x, {_SORTED.format(c="r.b")} AS y FROM base l, base r), {lcs("texts")},
    lt AS (SELECT a, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS t FROM base), rt AS (SELECT b, unnest(regexp_extract_all(lower(b), '[a-z0-9]+')) AS t FROM base),
    idf AS (SELECT t, ln((1 + (SELECT count(*) FROM base)) / (1 + count(DISTINCT b))) + 1 AS idf FROM rt GROUP BY t),
    lw AS (SELECT a, t, count(*) * any_value(idf) AS w FROM lt JOIN idf USING (t) GROUP BY a, t), rw AS (SELECT b, t, count(*) * any_value(idf) AS w FROM rt JOIN idf USING (t) GROUP BY b, t),
    cosine AS (SELECT a, b, sum(lw.w * rw.w) / (SELECT sqrt(sum(w * w)) FROM lw z WHERE z.a = lw.a) / (SELECT sqrt(sum(w * w)) FROM rw z WHERE z.b = rw.b) * 100 AS c FROM lw JOIN rw USING (t) GROUP BY a, b),
    best AS (SELECT a, b, c FROM cosine QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) = 1),
    scores AS (
        SELECT a, b, CASE WHEN 200 * n / (length(x) + length(y)) >= {asked["fuzzy_threshold"]} THEN 2 * n / (length(x) + length(y)) END AS f,
               CASE WHEN c >= {asked["semantic_threshold"]} - 1e-9 THEN c / 100 END AS s, CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN greatest(0, 1 - abs(p - q) / greatest(abs(p), abs(q), 1)) END AS n
        FROM texts JOIN lcs USING (x, y) LEFT JOIN best USING (a, b)
    ),
    weighed AS (
        SELECT *, (coalesce(f * {f}, 0) + coalesce(s * {s}, 0) + coalesce(n * {n}, 0)) / (CASE WHEN f IS NULL THEN 0 ELSE {f} END + CASE WHEN s IS NULL THEN 0 ELSE {s} END + CASE WHEN n IS NULL THEN 0 ELSE {n} END) AS c,
               greatest(coalesce(f * {f}, -1), coalesce(s * {s}, -1), coalesce(n * {n}, -1)) AS top FROM scores WHERE f IS NOT NULL OR s IS NOT NULL OR n IS NOT NULL
    )
    SELECT a AS left_key, b AS right_key, round(round(c, 4), 3) AS confidence, CASE WHEN f * {f} = top THEN 'fuzzy' WHEN s * {s} = top THEN 'semantic' ELSE 'numeric' END AS match_type,
           CAST((f IS NOT NULL)::INT + (s IS NOT NULL)::INT + (n IS NOT NULL)::INT AS BIGINT) AS n_scores FROM weighed WHERE round(c, 4) >= {asked["accept_threshold"]}
"""
