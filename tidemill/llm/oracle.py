"""DuckDB SQL for those corpus queries that SQL can express in full."""

from __future__ import annotations

from . import quality, queries

_WORD = r"[^\x20\x09-\x0D]+"
_LEAF = ("domain", "lang", "source")


def _weight(level: str) -> str:
    known = queries.MIX.weights.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in known.items()) + f" ELSE {queries.MIX.other} END" if known else str(queries.MIX.other)


def _share(name: str, nodes: str, parents: tuple[str, ...], level: str) -> str:
    """CTE `name` with `b`: what each node (parents, level, cap) of `nodes` gets of its parent's `budget`."""
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""{name}_w AS (SELECT *, CAST({_weight(level)} AS HUGEINT) AS w FROM {nodes}),
    {name}_o AS (SELECT *, sum(w) OVER o - w AS w_before, sum(cap) OVER o - cap AS cap_before, sum(w) OVER ({part}) AS w_all FROM {name}_w
      WINDOW o AS ({part} ORDER BY cap * 1.0 / w, {level} ROWS UNBOUNDED PRECEDING)),
    {name}_s AS (SELECT *, cap * (w_all - w_before) <= w * (budget - cap_before) AS full_ FROM {name}_o),
    {name} AS (SELECT *, CASE WHEN full_ THEN cap ELSE w * (budget - coalesce(sum(cap) FILTER (full_) OVER ({part}), 0)) // (w_all - coalesce(sum(w) FILTER (full_) OVER ({part}), 0)) END AS b FROM {name}_s)"""


def _mix() -> str:
    mix = queries.MIX
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in ss)}) THEN '{d}'" for d, ss in queries.DOMAINS.items()) + " ELSE 'other' END"
    key = f"md5('{mix.seed}:' || CAST(b // t AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
    return f"""WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n_tokens) AS t, {mix.max_epochs} * sum(n_tokens) AS cap FROM d GROUP BY ALL),
    n1 AS (SELECT domain, sum(cap) AS cap, (SELECT sum(t) FROM leaf) * {mix.budget_num} // {mix.budget_den} AS budget FROM leaf GROUP BY domain),
    {_share('s1', 'n1', (), 'domain')},
    n2 AS (SELECT domain, lang, sum(cap) AS cap, any_value(s1.b) AS budget FROM leaf JOIN (SELECT domain, b FROM s1) s1 USING (domain) GROUP BY domain, lang),
    {_share('s2', 'n2', ('domain',), 'lang')},
    n3 AS (SELECT domain, lang, source, t, cap, s2.b AS budget FROM leaf JOIN (SELECT domain, lang, b FROM s2) s2 USING (domain, lang)),
    {_share('s3', 'n3', ('domain', 'lang'), 'source')},
    r AS (SELECT d.*, s3.b, s3.t FROM d JOIN (SELECT domain, lang, source, b, t FROM s3 WHERE t > 0) s3 USING (domain, lang, source)),
    k AS (SELECT *, {key} AS key FROM r),
    p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM k)
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INT) AS epoch FROM (
      SELECT *, unnest(range(0, CAST(b // t AS BIGINT))) AS epoch FROM p UNION ALL SELECT *, CAST(b // t AS BIGINT) FROM p WHERE before < b % t)"""


def _url() -> str:
    rules = queries.URL_RULES
    ordered = sorted([(r, "allow") for r in rules.allow] + [(r, "block") for r in rules.block], key=lambda x: (-len(x[0]), x[0]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for r, v in ordered)
    labels = ", ".join(f"'{x}'" for x in rules.blocked_labels)
    return f"""SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN len(list_intersect(string_split(host, '.'), [{labels}])) > 0 THEN 'block' ELSE 'allow' END AS verdict FROM (
      SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)"""


def _quality() -> str:
    return f"""WITH t AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
    g AS (SELECT u, unnest(range(1, len(words) - 3)) AS i, words FROM t), h AS (SELECT u, i, array_to_string(words[i:i + 4], ' ') AS w FROM g),
    c AS (SELECT u, i, count(*) OVER (PARTITION BY u, w) AS n FROM h), v AS (SELECT u, count(DISTINCT place) AS n FROM (SELECT u, unnest(range(i, i + 5)) AS place FROM c WHERE n > 1) GROUP BY u),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_echo FROM t LEFT JOIN v USING (u)),
    f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_echo > 3 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed_rules FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f"""


def _ablation() -> str:
    bits = {r.name: 1 << r.bit for r in quality.RULES if r.name in quality.POLICIES["v1"]}
    one = "SELECT '{0}' AS rule, CAST(coalesce(sum(CASE WHEN failed_rules & {1} <> 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS failed, CAST(coalesce(sum(CASE WHEN failed_rules = {1} THEN 1 ELSE 0 END), 0) AS BIGINT) AS only_this FROM ledger"
    return f"WITH ledger AS MATERIALIZED ({_quality()}) " + " UNION ALL ".join(one.format(n, b) for n, b in bits.items())


def _warc() -> str:
    revisit = "best IS NOT NULL AND best <> page_id"
    return f"""WITH q AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    w AS (SELECT payload_digest, max(page_id) AS best FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN {revisit} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {revisit} THEN best END AS refers_to FROM q LEFT JOIN w USING (payload_digest)"""


ORACLE_SQL: dict[str, str] = {"op1_source_mix": _mix(), "op7_url_filter": _url(), "op9_quality_ledger": _quality(), "op10_warc": _warc(), "quality_ablation": _ablation()}
