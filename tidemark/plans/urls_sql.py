"""DuckDB text of the normaliser and the features: the independent side of the comparison."""

from __future__ import annotations

from ..fixtures import SUFFIX_RULES

_SPLIT = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


def _pct(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, '%'), lambda t, i: CASE WHEN i > 1 AND "
        "regexp_matches(t, '^[0-9a-fA-F]{2}') THEN upper(substr(t, 1, 2)) || substr(t, 3) ELSE t END), '%')"
    )


def norm_ctes(src: str, keep_fragment: bool = False, name: str = "norm") -> str:
    """CTE chain from ``src`` (a relation with raw_url) to ``name``."""
    keep = "s_upper_fragment" if keep_fragment else "''"
    deepest = max(r.lstrip("!").count(".") + 1 for r in SUFFIX_RULES)
    normal = ",".join(f"('{r}')" for r in SUFFIX_RULES if r[0] not in "*!")
    wild = ",".join(f"('{r[2:]}')" for r in SUFFIX_RULES if r[0] == "*")
    exc = ",".join(f"('{r[1:]}')" for r in SUFFIX_RULES if r[0] == "!")
    return rf"""
{name}_1 AS (SELECT *, replace(replace(replace(replace(replace(coalesce(raw_url, ''), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS s_text FROM {src}),
{name}_2 AS (SELECT *, regexp_replace(regexp_replace(s_text, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g'), '[\x00-\x1f\x7f]', '', 'g') AS s_clean FROM {name}_1),
{name}_3 AS (SELECT *, regexp_replace(s_clean, '^(https?|hxxps?):/([^/]|$)', '\1://\2', 'i') AS s_repaired FROM {name}_2),
{name}_4 AS (SELECT *, regexp_matches(s_repaired, '(?i)^[a-z][a-z0-9+.-]*:') AS s_has_scheme, split_part(s_repaired, '#', 1) AS s_no_fragment FROM {name}_3),
{name}_5 AS (SELECT *, CASE WHEN s_has_scheme THEN s_repaired ELSE '//' || s_repaired END AS s_target FROM {name}_4),
{name}_6 AS (SELECT *, lower(regexp_extract(s_target, {_SPLIT}, 2)) AS s_raw_scheme, regexp_extract(s_target, {_SPLIT}, 4) AS s_authority,
  regexp_extract(s_target, {_SPLIT}, 5) AS s_path, regexp_extract(s_target, {_SPLIT}, 7) AS s_query, regexp_extract(s_target, {_SPLIT}, 9) AS s_fragment FROM {name}_5),
{name}_7 AS (SELECT *, CASE s_raw_scheme WHEN 'hxxp' THEN 'http' WHEN 'hxxps' THEN 'https' ELSE s_raw_scheme END AS s_scheme,
  regexp_extract(s_authority, '^(.*@)', 1) AS s_userinfo, regexp_replace(s_authority, '^.*@', '') AS s_host_port FROM {name}_6),
{name}_8 AS (SELECT *, CASE WHEN contains(s_host_port, '[') THEN regexp_extract(s_host_port, '\[([^\]]*)', 1) ELSE split_part(s_host_port, ':', 1) END AS s_raw_host,
  CASE WHEN contains(s_host_port, '[') THEN regexp_extract(s_host_port, '\][^:]*:(.*)$', 1) ELSE regexp_extract(s_host_port, '^[^:]*:(.*)$', 1) END AS s_port_text FROM {name}_7),
{name}_9 AS (SELECT *, rtrim(lower(s_raw_host), '.') AS s_host FROM {name}_8),
{name}_10 AS (SELECT *, CASE WHEN s_clean = '' THEN 'empty'
  WHEN contains(s_authority, '[') <> contains(s_authority, ']') THEN 'parse_error'
  WHEN s_port_text <> '' AND (NOT regexp_matches(s_port_text, '^[0-9]+$') OR coalesce(TRY_CAST(s_port_text AS BIGINT), 99999) > 65535) THEN 'invalid_port'
  WHEN s_raw_host = '' THEN 'unparsed_host'
  WHEN regexp_matches(s_host, '^\.|\.\.|[^.]{{64}}') THEN 'invalid_hostname' ELSE 'ok' END AS parse_status,
  CASE WHEN s_port_text = '' THEN NULL ELSE TRY_CAST(s_port_text AS INTEGER) END AS s_port,
  {_pct('s_path')} AS s_upper_path, {_pct('s_query')} AS s_upper_query, {_pct('s_fragment')} AS s_upper_fragment FROM {name}_9),
{name}_11 AS (SELECT *, CASE WHEN (s_scheme = 'http' AND s_port = 80) OR (s_scheme = 'https' AND s_port = 443) THEN NULL ELSE s_port END AS s_kept_port,
  CASE WHEN s_upper_path = '' THEN '/' ELSE s_upper_path END AS s_final_path, {keep} AS s_final_fragment FROM {name}_10),
{name}_12 AS (SELECT *, s_userinfo || CASE WHEN contains(s_host, ':') THEN '[' || s_host || ']' ELSE s_host END || coalesce(':' || CAST(s_kept_port AS VARCHAR), '') AS s_netloc FROM {name}_11),
{name}_13 AS (SELECT *, CASE WHEN parse_status = 'ok' THEN CASE WHEN s_scheme = '' THEN '' ELSE s_scheme || ':' END || '//' || s_netloc || s_final_path
   || CASE WHEN s_upper_query = '' THEN '' ELSE '?' || s_upper_query END || CASE WHEN s_final_fragment = '' THEN '' ELSE '#' || s_final_fragment END
   ELSE s_no_fragment END AS normalized_url, CASE WHEN parse_status = 'ok' THEN s_host ELSE '' END AS host FROM {name}_12),
{name}_14 AS (SELECT *, normalized_url <> coalesce(raw_url, '') AS normalization_changed,
   CASE WHEN host = '' THEN 0 ELSE len(string_split(host, '.')) END AS n_labels,
   contains(host, ':') OR regexp_matches(host, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AS is_ip FROM {name}_13),
{name}_h AS (SELECT host, k, array_to_string(list_slice(string_split(host, '.'), n_labels - k + 1, n_labels), '.') AS tail
   FROM (SELECT DISTINCT host, n_labels FROM {name}_14 WHERE NOT is_ip AND n_labels > 0) d, range(1, {deepest + 1}) AS t(k) WHERE k <= n_labels),
{name}_s AS (SELECT host, coalesce(max(CASE WHEN tail IN ({exc.replace('(', '').replace(')', '')}) THEN k - 1 END), 0) AS e,
   max(CASE WHEN tail IN ({normal.replace('(', '').replace(')', '')}) THEN k
            WHEN split_part(tail, '.', 1) <> '' AND substr(tail, strpos(tail, '.') + 1) IN ({wild.replace('(', '').replace(')', '')}) AND contains(tail, '.') AND k > 1 THEN k ELSE 0 END) AS m
   FROM {name}_h GROUP BY host),
{name}_15 AS (SELECT a.*, CASE WHEN coalesce(s.e, 0) > 0 THEN s.e ELSE coalesce(s.m, 0) END AS suffix_labels FROM {name}_14 a LEFT JOIN {name}_s s ON a.host = s.host AND NOT a.is_ip),
{name}_16 AS (SELECT *, CASE WHEN suffix_labels = 0 THEN '' ELSE array_to_string(list_slice(string_split(host, '.'), n_labels - suffix_labels + 1, n_labels), '.') END AS public_suffix,
   CASE WHEN suffix_labels > 0 AND n_labels > suffix_labels THEN array_to_string(list_slice(string_split(host, '.'), n_labels - suffix_labels, n_labels), '.') ELSE '' END AS reg FROM {name}_15),
{name} AS (SELECT *, CASE WHEN reg <> '' THEN reg ELSE split_part(host, ':', 1) END AS registrable_domain,
   CASE WHEN reg <> '' THEN reg ELSE host END AS feature_domain,
   CASE WHEN is_ip OR n_labels = 0 THEN 0 WHEN suffix_labels = 0 THEN n_labels - 1 ELSE greatest(n_labels - suffix_labels - 1, 0) END AS subdomain_depth FROM {name}_16)
"""


def _n(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '{cls}', '', 'g'))"


V = "normalized_url"
_TYPES = r"regexp_replace(regexp_replace(regexp_replace(normalized_url, '[^\p{L}\p{Nd}]', '-', 'g'), '\p{Nd}', '0', 'g'), '\p{L}', 'a', 'g')"


def _c(ch: str) -> str:
    return f"length({V}) - length(replace({V}, '{ch}', ''))"


def _safe(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END"


_DIG, _LET = _n(V, r"[^\p{Nd}]"), _n(V, r"[^\p{L}]")
_TOK = f"len(regexp_extract_all({V}, '[A-Za-z0-9]+'))"
FEATURE_SQL = {
    "url_length": f"length({V})", "hostname_length": "length(host)", "path_length": "length(s_final_path)",
    "query_length": "length(s_upper_query)", "fragment_length": "length(s_final_fragment)",
    "digit_count": _DIG, "letter_count": _LET, "special_char_count": f"length({V}) - {_DIG} - {_LET}",
    "digit_ratio": _safe(_DIG, f"length({V})"), "letter_ratio": _safe(_LET, f"length({V})"),
    "special_char_ratio": _safe(f"(length({V}) - {_DIG} - {_LET})", f"length({V})"),
    "dot_count": _c("."), "hyphen_count": _c("-"), "underscore_count": _c("_"), "slash_count": _c("/"),
    "question_mark_count": _c("?"), "equals_sign_count": _c("="), "percent_sign_count": _c("%"), "at_sign_count": _c("@"),
    "subdomain_depth": "subdomain_depth",
    "path_segment_count": "len(list_filter(string_split(s_final_path, '/'), lambda x: x <> ''))",
    "query_parameter_count": "len(list_filter(string_split(s_upper_query, '&'), lambda x: x <> ''))",
    "has_port": "CASE WHEN s_kept_port IS NULL THEN 0 ELSE 1 END",
    "has_userinfo": "CASE WHEN contains(s_netloc, '@') THEN 1 ELSE 0 END",
    "host_is_ip": "CASE WHEN is_ip THEN 1 ELSE 0 END", "tld_length": "length(public_suffix)",
    "registrable_domain_length": "length(feature_domain)",
    "domain_digit_ratio": _safe(_n("feature_domain", r"[^0-9]"), "length(feature_domain)"),
    "domain_hyphen_ratio": _safe(_n("feature_domain", r"[^-]"), "length(feature_domain)"),
    "url_char_entropy": f"-list_sum(list_transform(list_distinct(string_split({V}, '')), lambda c: "
    f"((length({V}) - length(replace({V}, c, ''))) / length({V})) * log2((length({V}) - length(replace({V}, c, ''))) / length({V}))))",
    "longest_repeated_char_run": f"(SELECT max(z) FROM (SELECT count(*) AS z FROM (SELECT i, ch, i - row_number() OVER (PARTITION BY ch ORDER BY i) AS g "
    f"FROM (SELECT unnest(string_split({V}, '')) AS ch, unnest(range(1, length({V}) + 1)) AS i)) GROUP BY ch, g))",
    "char_type_transition_count": f"len(list_filter(range(2, length({V}) + 1), lambda i: substr({_TYPES}, i, 1) <> substr({_TYPES}, i - 1, 1)))",
    "token_count": _TOK,
    "token_mean_length": _safe(_n(V, "[^A-Za-z0-9]"), _TOK),
    "token_max_length": f"coalesce(list_max(list_transform(regexp_extract_all({V}, '[A-Za-z0-9]+'), lambda x: length(x))), 0)",
}
INT_FEATURES = [k for k in FEATURE_SQL if not (k.endswith("ratio") or k in ("url_char_entropy", "token_mean_length"))]


def feature_ctes(src: str, name: str = "feat", passthrough: str = "dataset, source_row, raw_url, label") -> str:
    cols = ",\n ".join(
        f"CAST({sql} AS {'INTEGER' if k in INT_FEATURES else 'DOUBLE'}) AS {k}" for k, sql in FEATURE_SQL.items())
    return norm_ctes(src, True, "fnorm") + f",\n{name} AS (SELECT {passthrough},\n {cols}\n FROM fnorm WHERE parse_status = 'ok')"
