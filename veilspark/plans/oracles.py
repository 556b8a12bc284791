"""SQL for DuckDB that gives the rows of the catalogue's queries, where SQL can express them.

RE2 has ASCII word boundaries and no lookaround; DuckDB's lambdas take the place of folds.
"""

from __future__ import annotations

from ..functions import patterns as P
from . import catalogue as Q
from . import corpus

# The detector's passes in RE2's dialect.
PASSES = (
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ip_address", r"(?i)\b(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4}\b"),
    ("date", r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-](?:\d{2}|\d{4}))\b"),
    ("phone", r"(?:\+?\d{1,3}[\s./-]?)?(?:\(?\d{2,5}\)?[\s./-]?){2,}\d{2,}"),
)
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPAN = 'STRUCT(pass INTEGER, s BIGINT, e BIGINT, category VARCHAR, v VARCHAR)'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, *names: str) -> str:
    """A table of literals."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"CAST('{x}' AS DOUBLE)"
        return text(x) if isinstance(x, str) else str(x)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({', '.join(names)}))"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    one = f"CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER)"
    return f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END)) % 10 = 0)"


def mod97(v: str) -> str:
    """Of digits and capitals; an empty text is 0."""
    return f"list_reduce(list_transform(string_split({v}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda r, x: (CASE WHEN x > 9 THEN r * 100 ELSE r * 10 END + x) % 97, 0)"


def fnv(v: str) -> str:
    """Over UTF-16 units: a character beyond the first 65,536 is its two surrogates."""
    units = f"flatten(list_transform(list_filter(string_split({v}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST((unicode(c) - 65536) // 1024 + 55296 AS BIGINT), CAST((unicode(c) - 65536) % 1024 + 56320 AS BIGINT)] END))"
    # Below 2 ** 57 throughout, so plain 64-bit numbers do.
    return f"list_reduce({units}, lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))"


def hash36(seed: str) -> str:
    return f"lower(to_base(CAST({seed} AS BIGINT), 36, 7))"


def _iban(v: str) -> str:
    own = f"upper(regexp_replace({v}, '\\s+', '', 'g'))"
    return f"(regexp_full_match({own}, '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}') AND {mod97(f'substr({own}, 5) || substr({own}, 1, 4)')} = 1)"


def _date(v: str) -> str:
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    dmy = r"^(\d{1,2})([./-])(\d{1,2})([./-])(\d{2}|\d{4})$"
    part = lambda p, i: f"TRY_CAST(regexp_extract({v}, '{p}', {i}) AS INTEGER)"
    good = lambda y, m, d: f"({y} BETWEEN 1900 AND 2099 AND TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL)"
    year = f"(CASE WHEN {part(dmy, 5)} < 100 THEN 1900 ELSE 0 END + {part(dmy, 5)})"
    return (
        f"CASE WHEN regexp_matches({v}, '{iso}') THEN {good(part(iso, 1), part(iso, 2), part(iso, 3))} "
        f"WHEN regexp_matches({v}, '{dmy}') AND regexp_extract({v}, '{dmy}', 2) = regexp_extract({v}, '{dmy}', 4) THEN {good(year, part(dmy, 3), part(dmy, 1))} ELSE FALSE END"
    )


def valid(i: int, v: str) -> str:
    d = digits(v)
    return (
        "TRUE",
        _iban(v),
        f"(length({d}) BETWEEN 13 AND 19 AND {luhn(d)})",
        f"len(list_filter(string_split({v}, '.'), lambda p: CAST(p AS INTEGER) > 255)) = 0",
        f"len(string_split({v}, ':')) = 8",
        _date(v),
        f"(length({d}) BETWEEN 7 AND 15 AND NOT {luhn(d)} AND regexp_matches({v}, '[\\s./()+-]'))",
    )[i]


def matches(i: int, source: str) -> str:
    """Valid, trimmed matches of a pass over source(doc_id, text): doc_id, pass, s, e, category, v."""
    category, pattern = PASSES[i]
    r = text(pattern)
    hint = ("contains(text, '@')", "regexp_matches(text, '[0-9]')", "regexp_matches(text, '[0-9]')", "regexp_matches(text, '[0-9]')", "contains(text, ':')", "regexp_matches(text, '[0-9]')", "regexp_matches(text, '[0-9]')")[i]
    size = "lambda x: length(x)"
    return f"""
        SELECT doc_id, {i} AS pass, a + (length(raw) - length(ltrim(raw, {_SPACE}))) AS s,
               a + (length(raw) - length(ltrim(raw, {_SPACE}))) + length(trim(raw, {_SPACE})) AS e, '{category}' AS category, trim(raw, {_SPACE}) AS v
        FROM (SELECT doc_id, ms[k] AS raw, CAST(coalesce(list_sum(list_transform(gaps[1:k], {size})), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], {size})), 0) AS BIGINT) AS a
              FROM (SELECT doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) AS k
                    FROM (SELECT doc_id, string_split_regex(text, {r}) AS gaps, regexp_extract_all(text, {r}) AS ms FROM {source} WHERE {hint})))
        WHERE {valid(i, f"trim(raw, {_SPACE})")}"""


def entities(source: str, dedupe: bool = True) -> str:
    """doc_id, s, e, category, v of the entities of source(doc_id, text)."""
    every = " UNION ALL ".join(matches(i, source) for i in range(len(PASSES)))
    same = " OR (k.category = x.category AND k.v = x.v)" if dedupe else ""
    return f"""
        SELECT doc_id, u.s AS s, u.e AS e, u.category AS category, u.v AS v
        FROM (SELECT doc_id, unnest(list_reduce(cands, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: (k.s < x.e AND x.s < k.e){same})) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS {SPAN}[]))) AS u
              FROM (SELECT doc_id, list(CAST(struct_pack(pass := pass, s := s, e := e, category := category, v := v) AS {SPAN}) ORDER BY pass, s) AS cands
                    FROM ({every}) GROUP BY doc_id))"""


DOCS = "(SELECT doc_id, text FROM documents)"
PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages)"
TALKS = "(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations)"
FIXTURE = "(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM " + values(list(enumerate(Q.FIXTURE)), "doc_id", "text") + ")"


#: Documents and, under negative ids, the fixture.
WITH_FIXTURE = f"(SELECT * FROM {DOCS} UNION ALL SELECT -1 - doc_id, text FROM {FIXTURE})"


def flat(source: str) -> str:
    return f"SELECT doc_id, category, v AS original, s AS span_start, e AS span_end FROM ({entities(source)})"


def one_pass(i: int) -> str:
    return f"SELECT doc_id, s AS span_start, e AS span_end, v AS value FROM ({matches(i, WITH_FIXTURE)})"


def lookup(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + " END"


def splice(spans: str, source: str) -> str:
    """doc_id, output_text, n_entities, has_pii from spans(doc_id, s, e, mask)."""
    return f"""
        SELECT t.doc_id, coalesce(f.out || substr(t.text, f.at + 1), t.text) AS output_text, coalesce(f.n, 0) AS n_entities, coalesce(f.out || substr(t.text, f.at + 1) <> t.text, FALSE) AS has_pii
        FROM {source} t LEFT JOIN (
            SELECT doc_id, max(e) AS at, count(*) AS n, string_agg(substr(text, prev + 1, s - prev) || ph, '' ORDER BY s) AS out
            FROM (SELECT p.doc_id, t.text, p.s, p.e, {lookup('p.mask', P.PLACEHOLDERS)} AS ph, coalesce(lag(p.e) OVER (PARTITION BY p.doc_id ORDER BY p.s), 0) AS prev
                  FROM ({spans}) p JOIN {source} t USING (doc_id))
            GROUP BY doc_id) f USING (doc_id)"""


def masked(source: str) -> str:
    return splice(f"SELECT doc_id, s, e, {lookup('category', P.MASK_OF_CATEGORY)} AS mask FROM ({entities(source, False)})", source)


def with_model() -> str:
    labels = [(P.MASK_OF_LABEL.get(a.split("-", 1)[-1] if a[1] == "-" else a), b, c) for a, b, c, _ in Q.MODEL_SPANS]
    model = " UNION ALL ".join(f"SELECT doc_id, 1 AS p, {b} AS s, {c} AS e, '{a}' AS category FROM {DOCS} WHERE length(text) >= 60" for a, b, c in labels if a)
    kind = "STRUCT(p INTEGER, s BIGINT, e BIGINT, category VARCHAR)"
    spans = f"""
        SELECT doc_id, u.s AS s, u.e AS e, u.category AS mask
        FROM (SELECT doc_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x.e AND x.s < k.e)) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS {kind}[]))) AS u
              FROM (SELECT doc_id, list(CAST(struct_pack(p := p, s := s, e := e, category := category) AS {kind}) ORDER BY p, s, s - e, category) AS c
                    FROM (SELECT doc_id, 0 AS p, s, e, {lookup('category', P.MASK_OF_CATEGORY)} AS category FROM ({entities(DOCS, False)}) UNION ALL {model}) GROUP BY doc_id))"""
    return f"SELECT doc_id, output_text, n_entities FROM ({splice(spans, DOCS)})"


def refill(original: str, own: str) -> str:
    at = f"length(regexp_replace(substr({original}, 1, i), '[^0-9]', '', 'g'))"
    c = f"substr({original}, i, 1)"
    return f"array_to_string(list_transform(range(1, length({original}) + 1), lambda i: CASE WHEN {c} BETWEEN '0' AND '9' THEN coalesce(nullif(substr({own}, {at}, 1), ''), '0') ELSE {c} END), '')"


def fakes(source: str, key: str) -> str:
    """doc_id, category, v, replacement for the entities of source; key is the seed's expression over category and v."""
    bban = "'50010517' || lpad(CAST(seed % 10000000000 AS VARCHAR), 10, '0')"
    check = f"printf('%02d', 98 - {mod97(f'({bban}) || ' + text('131400'))})"
    whole = f"'DE' || {check} || {bban}"
    iban = f"CASE WHEN regexp_matches(v, '\\s') THEN trim(regexp_replace({whole}, '(.{{4}})', '\\1 ', 'g')) ELSE {whole} END"
    n = f"length({digits('v')})"
    body = f"substr('4' || rpad(CAST(seed AS VARCHAR), 19, '0'), 1, greatest(least({n}, 19), 13) - 1)"
    card_digits = f"list_filter(list_transform(range(0, 10), lambda x: {body} || CAST(x AS VARCHAR)), lambda d: {luhn('d')})[1]"
    codes = "[" + ", ".join(text(c) for c in P.CALLING_CODES) + "]"
    code = f"CASE WHEN starts_with(ltrim(v), '+') THEN coalesce(list_filter({codes}, lambda c: starts_with({digits('v')}, c) AND {n} - length(c) >= 6)[1], substr({digits('v')}, 1, least(3, greatest({n} - 6, 1)))) ELSE '' END"
    phone_digits = f"substr({code} || {text(P.DIGITS)} || CAST(seed AS VARCHAR), 1, {n})"
    day, month = "printf('%02d', seed % 27 + 1)", "printf('%02d', seed_month % 12 + 1)"
    year = "CASE WHEN regexp_matches(v, '^\\d{1,2}[./-]\\d{1,2}[./-]\\d{2}$') THEN '88' ELSE '1988' END"
    mark = "regexp_extract(v, '^\\d{1,2}([./-])', 1)"
    date = f"CASE WHEN regexp_matches(v, '^\\d{{4}}-') THEN '1988-' || {month} || '-' || {day} ELSE {day} || {mark} || {month} || {mark} || {year} END"
    return f"""
        SELECT doc_id, category, v, k, s, CASE category
            WHEN 'email' THEN 'person-' || substr({hash36('seed')}, 1, 6) || '@example.invalid'
            WHEN 'iban' THEN {iban}
            WHEN 'credit_card' THEN {refill('v', 'card_digits')}
            WHEN 'ip_address' THEN CASE WHEN contains(v, ':') THEN '2001:db8::' || lower(to_base(seed % 65535, 16)) ELSE '203.0.113.' || CAST(seed % 254 + 1 AS VARCHAR) END
            WHEN 'date' THEN {date}
            WHEN 'phone' THEN {refill('v', 'phone_digits')}
        END AS replacement
        FROM (SELECT *, {card_digits} AS card_digits, {phone_digits} AS phone_digits
              FROM (SELECT doc_id, category, v, k, s, CAST({fnv('k')} AS BIGINT) AS seed, CAST({fnv("(k || ':month')")} AS BIGINT) AS seed_month
                    FROM (SELECT doc_id, category, v, s, {key} AS k FROM ({entities(source)}))))"""


def pseudonymised(source: str) -> str:
    """doc_id, text, output_text and n (entities) of source(doc_id, text): every place of each original is rewritten, words at word boundaries with up to two more letters."""
    word = r"[\p{L}\p{N}_]"
    kind = "STRUCT(s BIGINT, e BIGINT, r VARCHAR)"
    return f"""
        WITH t AS (SELECT * FROM {source}),
        f AS (SELECT doc_id, v, category, replacement, s FROM ({fakes(source, 'v')})),
        pairs AS (SELECT doc_id, v, arg_max(replacement, s) AS r, regexp_full_match(v, '[\\p{{L}}\\p{{N}}\\s-]+') AS wordy FROM f GROUP BY doc_id, v),
        cut AS (SELECT doc_id, text, v, r, wordy, CASE WHEN wordy THEN string_split(lower(text), lower(v)) ELSE string_split(text, v) END AS gaps FROM pairs JOIN t USING (doc_id)),
        places AS (SELECT doc_id, text, v, r, wordy, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + (k - 1) * length(v) AS BIGINT) AS s
                   FROM (SELECT *, unnest(range(1, len(gaps))) AS k FROM cut)),
        hits AS (SELECT doc_id, s, s + length(v) AS e, r FROM places WHERE NOT wordy
                 UNION ALL
                 SELECT doc_id, s, s + length(v) + length(more), r || more FROM (
                     SELECT *, regexp_extract(substr(text, s + length(v) + 1, 3), '^(\\p{{L}}{{0,2}})($|[^\\p{{L}}\\p{{N}}_])', 1) AS more,
                            regexp_matches(substr(text, s + length(v) + 1, 3), '^(\\p{{L}}{{0,2}})($|[^\\p{{L}}\\p{{N}}_])') AS ends FROM places WHERE wordy)
                 WHERE ends AND (s = 0 OR NOT regexp_matches(substr(text, s, 1), '{word}'))),
        kept AS (SELECT doc_id, u.s AS s, u.e AS e, u.r AS r
                 FROM (SELECT doc_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x.e AND x.s < y.e)) > 0 THEN acc ELSE list_append(acc, x) END, CAST([] AS {kind}[]))) AS u
                       FROM (SELECT doc_id, list(CAST(struct_pack(s := s, e := e, r := r) AS {kind}) ORDER BY s, s - e) AS c FROM hits GROUP BY doc_id))),
        done AS (SELECT doc_id, max(e) AS upto, string_agg(substr(text, prev + 1, s - prev) || r, '' ORDER BY s) AS out
                 FROM (SELECT kept.*, t.text, coalesce(lag(kept.e) OVER (PARTITION BY kept.doc_id ORDER BY kept.s), 0) AS prev FROM kept JOIN t USING (doc_id)) GROUP BY doc_id)
        SELECT t.doc_id, t.text, coalesce(out || substr(t.text, upto + 1), t.text) AS output_text, coalesce(n, 0) AS n
        FROM t LEFT JOIN done USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id) USING (doc_id)"""


_STRIP = f"trim(text, {_SPACE})"
def fake_id(v: str) -> str:
    """v with digits from the stream and letters from the turned streams; seed and low_seed are columns."""
    c = f"substr({v}, i, 1)"
    before = lambda kind: f"length(regexp_replace(substr({v}, 1, i - 1), '[^{kind}]', '', 'g'))"
    turned = lambda stream, kind, seed: f"substr({text(stream)}, CAST(({before(kind)} + {seed}) % {len(stream)} AS INTEGER) + 1, 1)"
    digit = f"coalesce(nullif(substr(repeat({text(P.DIGITS)} || CAST(seed AS VARCHAR), 3), {before('0-9')} + 1, 1), ''), '0')"
    return f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN {c} BETWEEN '0' AND '9' THEN {digit} WHEN regexp_matches({c}, '[A-Z]') THEN {turned(P.UPPER, 'A-Z', 'seed')} WHEN regexp_matches({c}, '[a-z]') THEN {turned(P.LOWER, 'a-z', 'low_seed')} ELSE {c} END), '')"


_QUICK = (r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?:\+?\d[\s\-/.()]*){7,}", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", r"\b(?:\d[ -]?){13,19}\b")


def chunked(limit: int | str, least: int, overlap: int, source: str | None = None) -> str:
    """Chunks of the documents, or of source(doc_id, text, lim) when limit is its column lim."""
    early = min(max(1, min(least, limit)), limit // 2) if isinstance(limit, int) else f"least(greatest(1, least({least}, lim)), lim // 2)"
    lim = "" if source is None else ", lim"
    last = lambda mark, k: f"length(substr(text, 1, target + {k})) - strpos(reverse(substr(text, 1, target + {k})), {mark}) - {k} + 1"
    found = lambda mark, k: f"CASE WHEN contains(substr(text, 1, target + {k}), {mark}) THEN {last(mark, k)} ELSE -1 END"
    sentence = "CASE WHEN regexp_matches(slice, '(?s)^.*[.!?。！？][)\"''\\]”’]*\\s+') THEN a + length(regexp_extract(slice, '(?s)^(.*[.!?。！？][)\"''\\]”’]*\\s+)', 1)) ELSE -1 END"
    step = f"""
        SELECT doc_id, text{lim}, chunk, a, CASE WHEN length(text) - a <= {limit} THEN length(text) WHEN para >= low THEN para + 2 WHEN line >= low THEN line + 1 WHEN sent >= low THEN sent WHEN word >= low THEN word + 1 ELSE target END AS b,
               CASE WHEN length(text) - a <= {limit} THEN 'end' WHEN para >= low THEN 'paragraph' WHEN line >= low THEN 'line' WHEN sent >= low THEN 'sentence' WHEN word >= low THEN 'word' ELSE 'hard' END AS boundary
        FROM (SELECT *, {found("chr(10) || chr(10)", 2)} AS para, {found("chr(10)", 1)} AS line, {sentence} AS sent, {found("' '", 1)} AS word
              FROM (SELECT doc_id, text{lim}, chunk, a, a + {limit} AS target, a + {early} AS low, substr(text, a + 1, {limit}) AS slice FROM %s))"""
    return f"""
        WITH RECURSIVE c AS (
            SELECT * FROM ({step % f"(SELECT doc_id, text{lim}, 0 AS chunk, 0 AS a FROM {source or DOCS} WHERE length(text) > 0)"})
            UNION ALL
            SELECT * FROM ({step % f"(SELECT doc_id, text{lim}, chunk + 1 AS chunk, b - CASE WHEN boundary IN ('word', 'hard') THEN least({overlap}, b - a - 1) ELSE 0 END AS a FROM c WHERE boundary <> 'end')"}))
        SELECT doc_id, chunk::BIGINT AS chunk, a::BIGINT AS chunk_start, least(b, length(text))::BIGINT AS chunk_end, boundary, sha256(substr(text, a + 1, b - a)) AS text_sha256 FROM c"""


def triage(source: str) -> str:
    """Decision, reason and signals of each text of source(doc_id, text)."""
    has = lambda c, p: f"regexp_matches({c}, {text('(?i)' + p)})"
    strip = lambda c: f"regexp_replace(regexp_replace({c}, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')"
    caps = lambda c: f"(upper({c}) = {c} AND lower({c}) <> {c})"
    title = lambda c: f"(regexp_full_match({c}, '\\p{{Lu}}[\\p{{L}}''’-]+') AND NOT {caps(c)})"

    def tokens(pattern: str) -> str:
        r = text(pattern)
        return f"""(SELECT doc_id, open, k, s, {strip("ms[k]")} AS token FROM (
            SELECT doc_id, open, k, ms, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
            FROM (SELECT doc_id, open, gaps, ms, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, open, string_split_regex(open, {r}) AS gaps, regexp_extract_all(open, {r}) AS ms FROM short))))"""

    names = ", ".join(text(n) for n in P.FIRST_NAMES)
    particles = ", ".join(text(n) for n in P.PARTICLES)
    own = f"trim(text, {_SPACE})"
    flat = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    low = " OR ".join(has("flat", p) for p in P.LOW_RISK)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
        e AS ({entities(source)}),
        found AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
        cut AS (SELECT doc_id, max(e) AS upto, string_agg(substr(text, prev + 1, s - prev) || repeat(' ', e - s), '' ORDER BY s) AS out
                FROM (SELECT e.*, t.text, coalesce(lag(e.e) OVER (PARTITION BY e.doc_id ORDER BY e.s), 0) AS prev FROM e JOIN t USING (doc_id)) GROUP BY doc_id),
        sized AS (SELECT t.doc_id, {own} AS own, {flat} AS flat, coalesce(n, 0) AS n, coalesce(out || substr(text, upto + 1), text) AS open,
                         length({own}) > {P.BYPASS_CHARS} OR len(string_split_regex({own}, '\\r\\n|\\r|\\n')) > {P.BYPASS_LINES} AS large
                  FROM t LEFT JOIN found USING (doc_id) LEFT JOIN cut USING (doc_id)),
        short AS (SELECT * FROM sized WHERE own <> '' AND NOT large),
        words AS {tokens(r"\b[\p{L}'’-]{2,}\b")},
        capitals AS {tokens(r"\b\p{Lu}[\p{L}'’-]{1,}\b")},
        first_name AS (SELECT DISTINCT doc_id FROM words WHERE lower(token) IN ({names})),
        parts AS (SELECT DISTINCT a.doc_id FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.k = a.k + 1
                  WHERE regexp_full_match(substr(a.open, a.s + length(a.token) + 1, b.s - a.s - length(a.token)), '\\s+') AND {title("a.token")} AND ({title("b.token")} OR lower(b.token) IN ({particles}))),
        middle AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, token, regexp_replace(substr(open, 1, s), '[\\s"''(\\[{{]+$', '') AS ahead FROM capitals)
                   WHERE token <> '' AND NOT {caps("token")} AND ahead <> '' AND NOT regexp_matches(ahead, '[.!?。！？:;]$')),
        signals AS (SELECT doc_id, concat_ws(',', CASE WHEN {has("open", P.HONORIFIC)} THEN 'honorific' END, CASE WHEN {has("open", P.ADDRESS)} THEN 'address' END, CASE WHEN {has("open", P.COMPANY)} THEN 'company' END,
                           CASE WHEN {has("open", P.ID_CONTEXT)} OR {has("open", P.ID_VALUE)} THEN 'id_context' END, CASE WHEN doc_id IN (SELECT doc_id FROM first_name) THEN 'known_first_name' END,
                           CASE WHEN doc_id IN (SELECT doc_id FROM parts) THEN 'multi_part_name' END, CASE WHEN doc_id IN (SELECT doc_id FROM middle) THEN 'mid_sentence_capitalized_token' END) AS risk FROM short)
        SELECT doc_id, CASE WHEN own = '' THEN 'safe_skip_ai' WHEN large OR risk <> '' THEN 'needs_ai' WHEN n > 0 THEN 'deterministic_only' WHEN {low} THEN 'safe_skip_ai' ELSE 'needs_ai' END AS decision,
               CASE WHEN own = '' THEN 'empty' WHEN large THEN 'too_large_for_bypass' WHEN risk <> '' THEN 'open_semantic_risk' WHEN n > 0 THEN 'structured_pii_only' WHEN {low} THEN 'explicit_low_risk_snippet' ELSE 'not_explicitly_low_risk' END AS reason,
               coalesce(risk, '') AS risk_signals
        FROM sized LEFT JOIN signals USING (doc_id)"""


def sessions(source: str, key: str, minutes: int) -> str:
    """source's rows with a session number; ts in microseconds as us."""
    return f"""
        SELECT *, sum(CASE WHEN us - prev > {minutes * 60_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY us) AS session
        FROM (SELECT *, lag(us) OVER (PARTITION BY {key} ORDER BY us) AS prev FROM (SELECT *, epoch_us(ts) AS us FROM {source}))"""


_MOMENT = f"epoch_us(TIMESTAMP '{Q.MOMENT}')"
_TTL = 3 * 24 * 60
_EVENTS = "(SELECT CAST(user_id AS VARCHAR) AS key, ts, CASE event_type WHEN 'purchase' THEN 'clear' ELSE 'write' END AS kind, 'fake' || CAST(event_id % 5 AS VARCHAR) AS fake, CAST(event_id AS VARCHAR) AS original FROM events WHERE event_type <> 'error')"
_STATE = f"""
    WITH e AS (SELECT * FROM {_EVENTS} WHERE epoch_us(ts) <= {_MOMENT}),
    w AS ({sessions("(SELECT * FROM e WHERE kind = 'write')", "key", _TTL)}),
    l AS (SELECT *, max(session) OVER (PARTITION BY key) AS last_session, max(us) OVER (PARTITION BY key) AS touched_us FROM w),
    c AS (SELECT key, max(epoch_us(ts)) AS cleared FROM e WHERE kind = 'clear' GROUP BY key)
    SELECT l.key, fake, max_by(original, us) AS original, max(touched_us) AS touched_us FROM l LEFT JOIN c ON l.key = c.key
    WHERE session = last_session AND {_MOMENT} - touched_us <= {_TTL * 60_000_000} AND (cleared IS NULL OR us > cleared) GROUP BY l.key, fake"""
_STREAM = f"""
    WITH c AS (SELECT *, epoch_us(ts) // 1000 AS ms, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS clears,
                      max(CASE WHEN kind = 'write' THEN epoch_us(ts) // 1000 END) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ms FROM {_EVENTS}),
    g AS (SELECT *, sum(CASE WHEN kind = 'write' AND ms - last_ms > {_TTL * 60_000} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS gaps FROM c),
    f AS (SELECT *, CASE WHEN kind = 'write' AND row_number() OVER (PARTITION BY key, clears, gaps, kind, fake ORDER BY ts) = 1 THEN 1 ELSE 0 END AS fresh FROM g)
    SELECT key, ms * 1000 AS us, kind AS action, CAST(CASE kind WHEN 'clear' THEN 0 ELSE sum(fresh) OVER (PARTITION BY key, clears, gaps ORDER BY ts) END AS BIGINT) AS n FROM f"""
_CLEARED = _STATE.replace("    SELECT l.key, fake", "    , every AS (SELECT max(epoch_us(ts)) AS last_us FROM events WHERE event_type = 'error' AND event_id % 50 = 0 AND epoch_us(ts) <= " + _MOMENT + ")\n    SELECT l.key, fake").replace(" GROUP BY l.key, fake", " AND us > coalesce((SELECT last_us FROM every), 0) GROUP BY l.key, fake")
#: Chunks of more than 1200 characters in halves: each is a text of its own, whose pieces begin where it does.
_RETRY = f"""
    WITH own AS (SELECT c.*, substr(d.text, chunk_start + 1, chunk_end - chunk_start) AS part, chunk_end - chunk_start AS n FROM ({chunked(8000, 1200, 160)}) c JOIN {DOCS} d USING (doc_id)),
    named AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) AS id FROM own),
    halves AS ({chunked("lim", 1200, 0, "(SELECT id AS doc_id, part AS text, greatest(1200, (n + 1) // 2) AS lim FROM named WHERE n > 1200)")}),
    every AS (SELECT doc_id, chunk AS c, 0 AS p, chunk_start, chunk_end, boundary, text_sha256 FROM named WHERE n <= 1200
              UNION ALL SELECT named.doc_id, named.chunk, halves.chunk, named.chunk_start + halves.chunk_start, named.chunk_start + halves.chunk_end, halves.boundary, halves.text_sha256 FROM halves JOIN named ON named.id = halves.doc_id)
    SELECT doc_id, row_number() OVER w - 1 AS chunk, chunk_start, chunk_end, boundary, text_sha256, row_number() OVER w - 1 AS piece FROM every WINDOW w AS (PARTITION BY doc_id ORDER BY c, p)"""
_SIZES = values(corpus.SIZES, "size_label", "n")
_VARIANTS = values([(v,) for v in corpus.VARIANTS], "variant")
_MEASURES = values([("background", 70), ("paste", 110)], "measurement", "base")
_ALL = values([(t, t in corpus.PLAIN_TYPES) for t in corpus.VALUES], "type", "plain")


def _case(number: str) -> str:
    return f"CASE WHEN {number} IS NULL OR isnan({number}) OR isinf({number}) THEN NULL ELSE {number} END"


_CATEGORIES = ", ".join(text(c) for c in P.CATEGORIES)
_RESPONSES = f"""
    SELECT id, CASE WHEN NOT ok THEN 'parse_failed' END AS error, CASE WHEN ok THEN CAST(len(es) AS INTEGER) END AS n
    FROM (SELECT id, es, json_type(j, '$.entities') IS NOT DISTINCT FROM 'ARRAY' AND len(list_filter(es, lambda e: NOT coalesce(
            json_type(e, '$.original') = 'VARCHAR' AND json_type(e, '$.replacement') = 'VARCHAR' AND (e ->> '$.category') IN ({_CATEGORIES})
            AND coalesce(json_type(e, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), TRUE), FALSE))) = 0 AS ok
          FROM (SELECT id, j, json_extract(j, '$.entities[*]') AS es FROM (SELECT id, CASE WHEN json_valid(r) THEN r::JSON ELSE '{{}}'::JSON END AS j FROM {values([(i, r) for i, r in enumerate(Q.RESPONSES)], "id", "r")})))"""
_ONCE = "length(output_text) > 0 AND length(shown) - length(replace(shown, output_text, '')) = length(output_text)"


ORACLE_SQL: dict[str, str] = {
    "parse_responses": _RESPONSES,
    "chunk_retry": _RETRY,
    "mapping_cleared": _CLEARED,
    "anonymize_structured": f"SELECT doc_id, output_text, output_text <> text AS has_pii, n AS n_entities FROM ({pseudonymised(DOCS)})",
    "remask": f"""
        SELECT doc_id, ok AS remasked, CASE WHEN ok THEN replace(shown, output_text, masked) ELSE shown END AS remasked_text
        FROM (SELECT *, masked <> text AND {_ONCE} AS ok
              FROM (SELECT a.doc_id, a.text, a.output_text, '> ' || a.output_text AS shown, m.output_text AS masked FROM ({pseudonymised(DOCS)}) a JOIN ({masked(DOCS)}) m USING (doc_id)))""",
    "engine_settings": f"""
        SELECT id, coalesce(last_value(e IGNORE NULLS) OVER w, TRUE) AS enabled, coalesce(last_value(m IGNORE NULLS) OVER w, 'reversible') AS mode, kind = 'set_mode' AND NOT refused AS clears, CASE WHEN refused THEN 'simple_model_permission_missing' END AS error
        FROM (SELECT *, CASE WHEN kind = 'set_enabled' THEN value = 'true' END AS e, CASE WHEN kind = 'set_mode' AND NOT refused THEN CASE WHEN value = 'simple' THEN 'simple' ELSE 'reversible' END END AS m
              FROM (SELECT *, kind = 'set_mode' AND value = 'simple' AND NOT allowed AS refused FROM {values([(i, *r) for i, r in enumerate(Q.CONTROL_EVENTS)], "id", "kind", "value", "allowed")}))
        WINDOW w AS (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "engine_disabled": f"SELECT doc_id, text AS output_text, FALSE AS has_pii, CAST(0 AS BIGINT) AS n_entities FROM {DOCS}",
    "engine_simple": masked(TALKS),
    "runtime_info": "SELECT name, CAST(value AS BIGINT) AS value FROM (VALUES ('long_text_from', 4000), ('chunk_chars', 8000), ('chunk_least', 1200), ('chunk_most', 18000), ('budget_ms', 11000), ('chunk_timeout_ms', 5000), ('quota_retries', 5), ('mapping_ttl_minutes', 30)) AS t(name, value)",
    "engine_status": "SELECT * FROM (VALUES (FALSE, 'simple', FALSE), (TRUE, 'reversible', TRUE)) AS t(enabled, mode, model_ready)",
    **{name: one_pass(i) for i, name in enumerate(("detect_email", "detect_iban", "detect_card", "detect_ipv4", "detect_ipv6", "detect_date", "detect_phone"))},
    "entities_documents": flat(DOCS),
    "entities_pages": flat(PAGES),
    "entities_conversations": flat(f"(SELECT * FROM {TALKS} UNION ALL SELECT -1 - doc_id, text FROM {FIXTURE})"),
    "entities_fixture": flat(FIXTURE),
    "mask_documents": masked(DOCS),
    "mask_pages": masked(PAGES),
    "mask_conversations": masked(TALKS),
    "mask_with_model": with_model(),
    "category_summary": f"SELECT lang, {lookup('category', P.MASK_OF_CATEGORY)} AS category, count(*) AS n FROM ({entities(DOCS, False)}) JOIN documents USING (doc_id) GROUP BY ALL",
    "document_categories": f"SELECT doc_id, {lookup('category', P.MASK_OF_CATEGORY)} AS category, count(*) AS n FROM ({entities(DOCS, False)}) GROUP BY ALL",
    "pii_by_source": f"SELECT source, count(*) AS docs, count(n) AS docs_with_pii, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_entities FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({entities(DOCS)}) GROUP BY doc_id) USING (doc_id) GROUP BY source",
    "scan_gate": f"SELECT doc_id, CASE WHEN {_STRIP} = '' THEN FALSE WHEN length({_STRIP}) >= {P.SCAN_FROM} THEN TRUE ELSE " + " OR ".join(f"regexp_matches({_STRIP}, {text(p)})" for p in _QUICK) + f" END AS should_scan, length({_STRIP}) >= {P.RESTORE_FROM} AS should_restore FROM {DOCS}",
    "seeds": f"SELECT doc_id, seed, {hash36('seed')} AS hash36 FROM (SELECT doc_id, CAST({fnv('text')} AS BIGINT) AS seed FROM {WITH_FIXTURE})",
    "fake_structured": f"SELECT doc_id, category, v AS original, replacement FROM ({fakes(WITH_FIXTURE, 'v')})",
    "fake_keyed": f"SELECT doc_id, category, v AS original, replacement, k AS entity_key FROM ({fakes(DOCS, chr(39).join(['category || ', ':', ' || CASE category WHEN ', 'email', ' THEN lower(v) ELSE v END']))})",
    "fake_ids": f"SELECT c_custkey, {fake_id('c_name')} AS id_value, 'Redacted-' || substr({hash36('seed')}, 1, 6) AS other_value FROM (SELECT c_custkey, c_name, CAST({fnv('c_name')} AS BIGINT) AS seed, CAST({fnv("(c_name || ':lower')")} AS BIGINT) AS low_seed FROM customer)",
    "copy_controls": f"""
        SELECT id, regexp_matches(concat_ws(' ', nullif(label, ''), nullif(title, '')), {text('(?i)' + P.COPY_CONTROL)}) AS is_control, NOT alt AND ((lower(k) = 'c' AND (ctrl OR meta)) OR (lower(k) = 'insert' AND ctrl AND NOT meta)) AS is_shortcut
        FROM {values([(i, *r) for i, r in enumerate(Q.CONTROLS)], "id", "label", "title", "k", "ctrl", "meta", "alt")}""",
    "anonymize_without_model": f"SELECT doc_id, decision, CASE decision WHEN 'needs_ai' THEN 'error' ELSE 'complete' END AS analysis_status, CASE decision WHEN 'needs_ai' THEN 'ai_unavailable' END AS error, decision = 'needs_ai' AS blocked FROM ({triage(DOCS)})",
    "restore_roundtrip": f"SELECT doc_id, text AS restored_text FROM {DOCS}",
    "triage_documents": triage(DOCS),
    "triage_conversations": triage(TALKS),
    "triage_limits": f"SELECT doc_id, n_chars, n_lines, n_chars > {P.BYPASS_CHARS} OR n_lines > {P.BYPASS_LINES} AS too_large FROM (SELECT doc_id, length({_STRIP}) AS n_chars, CASE WHEN {_STRIP} = '' THEN 0 ELSE len(string_split_regex({_STRIP}, '\\r\\n|\\r|\\n')) END AS n_lines FROM {DOCS})",
    "chunk_documents": chunked(8000, 1200, 160),
    "chunk_short": chunked(1000, 300, 40),
    "chunk_limit": f"""
        SELECT id, CAST(CASE WHEN quota IS NULL THEN 8000 WHEN tokens <= 0 THEN 1200 ELSE greatest(1200, least(18000, floor(tokens * 4))) END AS INTEGER) AS char_limit
        FROM (SELECT id, quota, floor(greatest(0, quota - greatest(0, coalesce(u, 0)) - greatest(0, coalesce(o, 0))) * ratio) AS tokens
              FROM (SELECT *, coalesce(CASE WHEN w > 0 THEN w END, CASE WHEN q > 0 THEN q END) AS quota FROM {values([(i, *r) for i, r in enumerate(Q.LIMITS)], "id", "w", "q", "u", "o", "ratio")}))""",
    "bench_corpus": f"SELECT size_label || '-' || variant AS case_id, size_label, variant, n AS target_chars, n AS actual_chars, CASE variant WHEN 'safe' THEN 0 WHEN 'no-punctuation' THEN {len(corpus.PLAIN_TYPES)} ELSE {len(corpus.VALUES)} END AS n_expected, FALSE AS violates FROM {values([*corpus.SIZES, corpus.LARGEST], 'size_label', 'n')} CROSS JOIN {_VARIANTS}",
    "latency_report": f"SELECT measurement, size_label, variant, CAST(2 AS BIGINT) AS runs, ms AS p50, ms AS p95, ms AS max, 1.0::DOUBLE AS complete_rate, 0.0::DOUBLE AS timeout_rate, 0.0::DOUBLE AS quota_retry_rate FROM (SELECT *, floor(base + n / 1000.0 * 15 + 0.5)::DOUBLE AS ms FROM {_MEASURES} CROSS JOIN {_SIZES} CROSS JOIN {_VARIANTS})",
    "latency_by_event": "SELECT event_type, count(*) AS runs, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS slowest FROM events GROUP BY event_type",
    "coverage_report": f"SELECT type, count(*) AS expected, count(*) AS protected FROM {_MEASURES} CROSS JOIN {_SIZES} CROSS JOIN {_VARIANTS} CROSS JOIN {_ALL} CROSS JOIN range(2) WHERE variant <> 'safe' AND (plain OR variant <> 'no-punctuation') GROUP BY type",
    "recommendations": f"SELECT 4000 AS long_text_threshold_chars, 8000 AS chunk_budget_chars, greatest(5000, CAST(ceil(p95 / 2 / 500) * 500 AS INTEGER)) AS chunk_timeout_ms, greatest(11000, CAST(ceil(p95 * 1.25 / 500) * 500 AS INTEGER)) AS analysis_budget_ms, 20000 AS largest_complete_chars, FALSE AS quota_retries_seen, FALSE AS partial_seen FROM (SELECT quantile_disc(floor(70 + n / 1000.0 * 15 + 0.5), 0.95) AS p95 FROM {_SIZES} CROSS JOIN {_VARIANTS} CROSS JOIN range(2))",
    "copy_intent": """
        SELECT event_id, user_id, coalesce(us - intent <= 7200000000, FALSE) AS honoured
        FROM (SELECT *, max(CASE WHEN event_type = 'click' THEN us END) OVER (PARTITION BY user_id ORDER BY us, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS intent
              FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'view')))
        WHERE event_type = 'view'""",
    "mapping_sessions": f"SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM ({sessions('events', 'user_id', P.TTL_MINUTES)}) GROUP BY ALL",
    "mapping_state": _STATE,
    "mapping_stream": _STREAM,
    "orphan_mappings": "SELECT user_id, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0) GROUP BY user_id",
    "kept_mappings": "SELECT user_id, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 0) GROUP BY user_id",
    "best_entity": f"""
        SELECT doc_id, entity_key, category, span_start
        FROM (SELECT doc_id, lower(v) AS entity_key, category, s AS span_start, row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY CASE WHEN category = 'credit_card' THEN 1 ELSE 2 END DESC, CASE WHEN category = 'credit_card' THEN 0.5 ELSE 0 END DESC, s, pass) AS r
              FROM ({" UNION ALL ".join(matches(i, DOCS) for i in range(len(PASSES)))}))
        WHERE r = 1""",
    "unique_replace": "SELECT doc_id, n = 1 AS \"unique\", sha256(CASE WHEN n = 1 THEN replace(text, 'Apache License', '<X>') ELSE text END) AS text_sha256 FROM (SELECT doc_id, text, (length(text) - length(replace(text, 'Apache License', ''))) // 14 AS n FROM documents)",
    "text_digests": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "message_lookup": """
        SELECT c_custkey, replace(replace(coalesce(m, CASE WHEN c_nationkey <> 7 THEN 'nation ' || CAST(c_nationkey AS VARCHAR) END, CAST(c_nationkey AS VARCHAR)), '$2', 'x'), '$1', c_mktsegment) AS message
        FROM customer LEFT JOIN (SELECT n_nationkey, n_name || ' has $1 of $2' AS m FROM nation WHERE n_regionkey <> 3) ON n_nationkey = c_nationkey""",
    "error_codes": f"""
        SELECT id, CASE WHEN NOT has_gpu THEN 'webgpu_unavailable' WHEN regexp_matches(m, '(?i)quota') THEN 'simple_model_cache_quota_exceeded'
            WHEN regexp_matches(m, '(?i)Failed to fetch|Load failed|NetworkError|404|403|not found|CORS') THEN 'simple_model_download_failed' WHEN regexp_matches(m, '(?i)webgpu') THEN 'webgpu_unavailable' ELSE 'simple_analysis_failed' END AS code,
            regexp_matches(m, '(?i)quota') AS is_quota
        FROM (SELECT id, has_gpu, coalesce(message, '') AS m FROM {values([(i, *r) for i, r in enumerate(Q.ERRORS)], "id", "message", "has_gpu")})""",
    "model_numbers": f"""
        SELECT id, CASE WHEN p IS NOT NULL THEN CASE WHEN p > 1 THEN p / 100 ELSE p END WHEN t > 0 THEN l / t END AS progress,
            CASE WHEN ok THEN CAST(least(greatest(1, floor(dk + 0.5)), floor(mk)) AS INTEGER) ELSE -1 END AS top_k, CASE WHEN ok THEN least(0.2::DOUBLE, mt) END AS temperature
        FROM (SELECT id, {_case('p')} AS p, l, t, dk, mk, mt, coalesce(dk IS NOT NULL AND mk >= 1 AND dt IS NOT NULL AND mt >= 0, FALSE) AS ok FROM {values([(i, *r) for i, r in enumerate(Q.NUMBERS)], "id", "p", "l", "t", "dk", "mk", "dt", "mt")})""",
}
