"""DuckDB SQL of the queries that SQL can express."""

#: A-Z lower-cased only; white space is \x20 and \x09-\x0D throughout.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH lines AS (
    SELECT doc_id, i, line, {LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key
    FROM (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
), hot AS (
    SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot USING (key)
GROUP BY doc_id
"""

#: What follows the first ://, its host and path, and the form that all spellings of a url share.
_REST = r"CASE WHEN contains({0}, '://') THEN regexp_replace({0}, '^.*?://', '', 's') END"
_HOST = "coalesce(" + LOWER.format(r"regexp_extract({0}, '^[^/?#]*', 0)") + ", '')"
_PATH = r"coalesce(regexp_extract({0}, '^[^/?#]*([^?#]*)', 1), '')"
_KEPT = (
    r"list_filter(string_split(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1), '&'), "
    r"lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))"
)
_CANONICAL = (
    r"regexp_replace(" + _HOST + r", '^(www|m)\.', '') || regexp_replace(" + _PATH + r", '(/index\.html?|\.html?|/)$', '')"
    r" || CASE WHEN len(" + _KEPT + r") > 0 THEN '?' || array_to_string(" + _KEPT + r", '&') ELSE '' END"
)


def _tag(tag: str, value: str) -> str:
    return f"regexp_extract(regexp_extract(html, '{tag}', 0, 'is'), '{value}', 1, 'is')"


_CANON_TAG = _tag(r"<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*>", r"\bhref\s*=\s*[\"'']?([^\"''\s>]+)")
_REFRESH_TAG = _tag(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>", r"\burl\s*=\s*[\"'']?([^\"''\s>;]+)")

OP8 = f"""
WITH RECURSIVE parts AS (
    SELECT page_id, url, rest, {_HOST.format('rest')} AS host, {_PATH.format('rest')} AS path,
        CASE WHEN rest IS NOT NULL THEN {_CANONICAL.format('rest')} END AS canon, html
    FROM (SELECT page_id, url, html, {_REST.format('url')} AS rest FROM pages)
), targets AS (
    SELECT canon, host, split_part(url, '://', 1) AS scheme, unnest([{_CANON_TAG}, {_REFRESH_TAG}]) AS target
    FROM parts WHERE canon IS NOT NULL AND html IS NOT NULL
), absolute AS (
    SELECT canon, CASE WHEN contains(target, '://') THEN target
        WHEN starts_with(target, '//') THEN scheme || ':' || target
        WHEN starts_with(target, '/') THEN scheme || '://' || host || target END AS target
    FROM targets
), target_parts AS (
    SELECT canon AS source, rest, {_HOST.format('rest')} AS host, {_PATH.format('rest')} AS path, {_CANONICAL.format('rest')} AS canon
    FROM (SELECT canon, {_REST.format('target')} AS rest FROM absolute WHERE target IS NOT NULL)
), edges AS (
    SELECT source AS a, canon AS b FROM target_parts UNION SELECT canon, source FROM target_parts
), reach(node, other) AS (
    SELECT canon, canon FROM parts WHERE canon IS NOT NULL UNION SELECT canon, canon FROM target_parts
    UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
), groups AS (
    SELECT node, min(other) AS grp FROM reach GROUP BY node
), rules(verdict, rule, rule_host, rule_path) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
        ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), spots AS (
    SELECT DISTINCT host, path, canon FROM (SELECT host, path, canon FROM parts UNION ALL SELECT host, path, canon FROM target_parts)
), explicit AS (
    SELECT host, path, canon, arg_max(verdict, length(rule)) AS verdict, arg_max(rule, length(rule)) AS rule
    FROM spots JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path, canon
), caught AS (
    SELECT grp FROM explicit JOIN groups ON canon = node
    GROUP BY grp HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
)
SELECT page_id, parts.host, parts.path, explicit.rule,
    coalesce(explicit.verdict, CASE WHEN caught.grp IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
LEFT JOIN explicit ON parts.host = explicit.host AND parts.path = explicit.path AND parts.canon IS NOT DISTINCT FROM explicit.canon
LEFT JOIN groups ON parts.canon = groups.node
LEFT JOIN caught ON groups.grp = caught.grp
"""

OP11 = rf"""
WITH pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), counts AS (
    SELECT lang, phrase, count(*) AS a
    FROM (
        SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5],
            lambda k: list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])))) AS phrase
        FROM pieces
    )
    GROUP BY ALL
), candidates AS (
    SELECT * FROM counts WHERE len(phrase) > 1 AND a >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, k, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates) c
    JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[:k]
    JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]
    JOIN (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang) t ON t.lang = c.lang
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, part, max(a) AS a
    FROM (
        SELECT lang, a, unnest(flatten(list_transform(range(2, len(phrase)),
            lambda k: list_transform(range(1, len(phrase) - k + 2), lambda i: phrase[i:i + k - 1])))) AS part
        FROM candidates
    )
    GROUP BY ALL
), ranked AS (
    SELECT w.*, array_to_string(w.phrase, ' ') AS name,
        row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, array_to_string(w.phrase, ' ')) AS rank
    FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.part = w.phrase
    WHERE i.a IS NULL OR 100 * i.a < 100 * w.a
)
SELECT lang, rank, name AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_TERMS = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH terms AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL
), sized AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM terms GROUP BY doc_id
), total AS (
    SELECT count(*) AS documents, sum(n)::BIGINT AS occurrences FROM sized
), weighted AS (
    SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), total
), asked AS (
    SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // occurrences))))::BIGINT AS score
    FROM asked JOIN weighted USING (term) JOIN terms USING (term) JOIN sized USING (doc_id), total
    GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""

_CONTROL = r"'([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|NEXT\])', '\1\\\2\3', 'g'"

OP13 = rf"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT -7, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS odd(i, role)
    )
), marked AS (
    SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
        length(regexp_replace(text, {_CONTROL})) AS written,
        length(regexp_replace(role, {_CONTROL})) AS role_written
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(written
        + CASE WHEN NOT opens THEN 6 WHEN role = 'user' THEN 7 WHEN role = 'system' THEN 6 WHEN role = 'assistant' THEN 1 ELSE 14 + role_written END
        + CASE WHEN NOT closes THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'system' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 8 END
    ))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

SQL: dict[str, str] = {
    "op8_url_filters": OP8,
    "op5_line_dedup": OP5,
    "op11_phrase_collocations": OP11,
    "op12_ranked_search": OP12,
    "op13_chat_formatting": OP13,
}
