"""URL normalisation and the 35 lexical features as column expressions.

Everything runs inside the JVM.  Two steps have no built-in equivalent and use an
Arrow UDF that sees only the rows that need it: HTML entities and non-ASCII host names.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import ratio, sha256

# The 35 feature names in dictionary order with their type.
FEATURES = [
    ("url_length", "int"), ("hostname_length", "int"), ("path_length", "int"),
    ("query_length", "int"), ("fragment_length", "int"), ("digit_count", "int"),
    ("letter_count", "int"), ("special_char_count", "int"), ("digit_ratio", "double"),
    ("letter_ratio", "double"), ("special_char_ratio", "double"), ("dot_count", "int"),
    ("hyphen_count", "int"), ("underscore_count", "int"), ("slash_count", "int"),
    ("question_mark_count", "int"), ("equals_sign_count", "int"), ("percent_sign_count", "int"),
    ("at_sign_count", "int"), ("subdomain_depth", "int"), ("path_segment_count", "int"),
    ("query_parameter_count", "int"), ("has_port", "int"), ("has_userinfo", "int"),
    ("host_is_ip", "int"), ("tld_length", "int"), ("registrable_domain_length", "int"),
    ("domain_digit_ratio", "double"), ("domain_hyphen_ratio", "double"),
    ("url_char_entropy", "double"), ("longest_repeated_char_run", "int"),
    ("char_type_transition_count", "int"), ("token_count", "int"),
    ("token_mean_length", "double"), ("token_max_length", "int"),
]
FEATURE_NAMES = [name for name, _ in FEATURES]

_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_IPV6 = (
    r"^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|([0-9a-f]{1,4}:){1,7}:|([0-9a-f]{1,4}:){1,6}(:[0-9a-f]{1,4})"
    r"|([0-9a-f]{1,4}:){1,5}(:[0-9a-f]{1,4}){1,2}|([0-9a-f]{1,4}:){1,4}(:[0-9a-f]{1,4}){1,3}"
    r"|([0-9a-f]{1,4}:){1,3}(:[0-9a-f]{1,4}){1,4}|([0-9a-f]{1,4}:){1,2}(:[0-9a-f]{1,4}){1,5}"
    r"|[0-9a-f]{1,4}:((:[0-9a-f]{1,4}){1,6})|:((:[0-9a-f]{1,4}){1,7}|:))$"
)
# Digits beyond \p{Nd} that count as digits in the feature dictionary's source language.
_DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐"


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(StringType())
def _idna(s: pd.Series) -> pd.Series:
    def encode(v):
        if v is None:
            return None
        try:
            return v.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return s.map(encode)


def _percent_upper(name: str) -> Column:
    return F.expr(
        f"if(instr({name}, '%') > 0, array_join(transform(split({name}, '%'), (x, i) -> "
        "if(i > 0 and x rlike '^[0-9a-fA-F]{2}', concat(upper(substr(x, 1, 2)), substr(x, 3)), x)), '%'), "
        f"{name})"
    )


def _fence(df: DataFrame) -> DataFrame:
    """One row in, one row out.  A later filter on parse_status (or the Arrow stage) would otherwise
    be pushed below every projection of the parser, copying its expression tree many times over."""
    return df.select(F.inline(F.array(F.struct("*"))))


def normalize_steps(df: DataFrame, raw: str = "raw_url", keep_fragment: bool = False) -> DataFrame:
    """Add every intermediate column (``s_*``) of the normaliser plus its result columns."""
    text = F.coalesce(F.col(raw), F.lit(""))
    entity = text.rlike("&[#a-zA-Z]")
    out = df.withColumn("s_text", F.coalesce(_unescape(F.when(entity, text)), text))
    out = out.withColumn(
        "s_clean",
        F.regexp_replace(
            F.regexp_replace("s_text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"[\x00-\x1f\x7f]", ""
        ),
    )
    out = out.withColumn("s_repaired", F.regexp_replace("s_clean", r"(?i)^(https?|hxxps?):/(?!/)", "$1://"))
    out = out.withColumn("s_has_scheme", F.col("s_repaired").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"))
    e = F.expr
    out = out.withColumn("s_no_fragment", e("substring_index(s_repaired, '#', 1)"))
    out = out.withColumns({
        "s_fragment": e("substr(s_repaired, length(s_no_fragment) + 2)"),
        "s_no_query": e("substring_index(s_no_fragment, '?', 1)"),
    })
    out = out.withColumns({
        "s_query": e("substr(s_no_fragment, length(s_no_query) + 2)"),
        "s_raw_scheme": e("if(s_has_scheme, lower(substring_index(s_no_query, ':', 1)), '')"),
    })
    out = out.withColumn(
        "s_rest",
        e("if(s_has_scheme, substr(s_no_query, length(s_raw_scheme) + 2), concat('//', s_no_query))"),
    )
    out = out.withColumns({
        "s_scheme": e("case s_raw_scheme when 'hxxp' then 'http' when 'hxxps' then 'https' else s_raw_scheme end"),
        "s_authority": e("if(startswith(s_rest, '//'), substring_index(substr(s_rest, 3), '/', 1), '')"),
    })
    out = out.withColumns({
        "s_path": e("if(startswith(s_rest, '//'), substr(s_rest, length(s_authority) + 3), s_rest)"),
        "s_host_port": e("substring_index(s_authority, '@', -1)"),
    })
    out = out.withColumns({
        "s_userinfo": e("substr(s_authority, 1, length(s_authority) - length(s_host_port))"),
        "s_bracket": e("instr(s_host_port, '[') > 0"),
    })
    out = out.withColumn(
        "s_raw_host",
        e("if(s_bracket, substring_index(substr(s_host_port, instr(s_host_port, '[') + 1), ']', 1), "
          "substring_index(s_host_port, ':', 1))"),
    )
    out = out.withColumn(
        "s_after_host",
        e("if(s_bracket, substr(s_host_port, instr(s_host_port, '[') + length(s_raw_host) + 2), "
          "substr(s_host_port, length(s_raw_host) + 1))"),
    )
    out = out.withColumns({
        "s_port_text": e("if(instr(s_after_host, ':') > 0, substr(s_after_host, instr(s_after_host, ':') + 1), '')"),
        "s_low_host": e("trim(TRAILING '.' FROM lower(s_raw_host))"),
    })
    out = _fence(out.drop("s_no_query", "s_rest", "s_host_port", "s_bracket", "s_after_host"))
    ascii_host = ~F.col("s_low_host").rlike(r"[^\x00-\x7F]")
    out = out.withColumn(
        "s_host",
        F.when(ascii_host & F.col("s_low_host").rlike(r"^\.|\.\.|[^.]{64}"), F.lit(None).cast("string"))
        .when(ascii_host, F.col("s_low_host"))
        .otherwise(_idna(F.when(~ascii_host, F.col("s_low_host")))),
    )
    out = out.withColumn(
        "parse_status",
        e("case when s_clean = '' then 'empty' "
          "when (instr(s_authority, '[') > 0) <> (instr(s_authority, ']') > 0) then 'parse_error' "
          "when s_port_text <> '' and (not s_port_text rlike '^[0-9]+$' "
          "or coalesce(try_cast(s_port_text as bigint), 99999) > 65535) then 'invalid_port' "
          "when s_raw_host = '' then 'unparsed_host' when s_host is null then 'invalid_hostname' else 'ok' end"),
    )
    out = _fence(out.drop("s_low_host"))
    ok = F.col("parse_status") == "ok"
    out = out.withColumns({
        "s_port": e("if(s_port_text = '', null, try_cast(s_port_text as int))"),
        "s_upper_path": _percent_upper("s_path"),
        "s_upper_query": _percent_upper("s_query"),
        "s_upper_fragment": _percent_upper("s_fragment"),
    })
    out = out.withColumns({
        "s_kept_port": e("if((s_scheme = 'http' and s_port = 80) or (s_scheme = 'https' and s_port = 443), null, s_port)"),
        "s_final_path": e("if(s_upper_path = '', '/', s_upper_path)"),
        "s_final_fragment": F.col("s_upper_fragment") if keep_fragment else F.lit(""),
    })
    out = out.withColumn(
        "s_netloc",
        e("concat(s_userinfo, if(instr(s_host, ':') > 0, concat('[', s_host, ']'), s_host), "
          "if(s_kept_port is null, '', concat(':', s_kept_port)))"),
    )
    out = out.withColumns({
        "normalized_url": F.when(ok, e(
            "concat(if(s_scheme = '', '', concat(s_scheme, ':')), '//', s_netloc, s_final_path, "
            "if(s_upper_query = '', '', concat('?', s_upper_query)), "
            "if(s_final_fragment = '', '', concat('#', s_final_fragment)))"))
        .otherwise(F.col("s_no_fragment")),
        "host": F.when(ok, F.col("s_host")).otherwise(F.lit("")),
    })
    return out.withColumn("normalization_changed", F.col("normalized_url") != text)


@dataclass(frozen=True)
class SuffixRules:
    """Public-suffix rules ready for matching: (match_text, plain, wild, exception), the label counts that occur, and
    whether the table is small enough to broadcast (a checked count)."""

    table: DataFrame
    depths: tuple[int, ...]
    small: bool


#: Rules that may be broadcast: at about 40 bytes a rule some 10 MB.
MAX_SUFFIX_RULES = 200_000


def _parsed(texts: DataFrame) -> DataFrame:
    """One row per rule text without its mark: the suffix labels it gives as plain, wildcard and exception rule."""
    rules = texts.selectExpr("rule", "regexp_replace(rule, '^(!|\\\\*\\\\.)', '') as match_text").selectExpr(
        "rule", "match_text", "size(split(match_text, '[.]')) as match_labels")
    n, wild, exception = F.col("match_labels"), F.startswith("rule", F.lit("*.")), F.startswith("rule", F.lit("!"))
    return rules.groupBy("match_text", "match_labels").agg(
        F.max(F.when(~wild & ~exception, n)).alias("plain"), F.max(F.when(wild, n + 1)).alias("wild"), F.max(F.when(exception, n - 1)).alias("exception"))


def suffix_rules(spark, rules: list[str]) -> SuffixRules:
    """Rules from their texts (``co.uk``, ``*.ck``, ``!www.ck``); depth and size are read from the list itself."""
    found: dict[str, list] = {}
    for rule in rules:
        text = rule.removeprefix("!").removeprefix("*.")
        kind = 2 if rule.startswith("!") else 1 if rule.startswith("*.") else 0
        row = found.setdefault(text, [text.count(".") + 1, None, None, None])
        row[1 + kind] = row[0] + (0, 1, -1)[kind]
    schema = "match_text string, match_labels int, plain int, wild int, exception int"
    frame = spark.createDataFrame(pa.Table.from_pylist([dict(zip(("match_text", "match_labels", "plain", "wild", "exception"), (t, *r))) for t, r in found.items()],
                                                       schema=pa.schema([("match_text", pa.string()), *((c, pa.int32()) for c in ("match_labels", "plain", "wild", "exception"))])), schema)
    return SuffixRules(frame, tuple(sorted({r[0] for r in found.values()})), len(found) <= MAX_SUFFIX_RULES)


def parse_suffix_rules(texts: DataFrame) -> SuffixRules:
    """Rules from a table of texts (column ``rule``); one pass over the rules finds the depths and the size."""
    table = _parsed(texts)
    row = table.agg(F.sort_array(F.collect_set("match_labels")).alias("depths"), F.count(F.lit(1)).alias("n")).first()
    return SuffixRules(table, tuple(row.depths or ()), row.n <= MAX_SUFFIX_RULES)


def attach_suffix(df: DataFrame, rules: SuffixRules, host: str = "host") -> DataFrame:
    """Longest public-suffix match: a trie level per label count that occurs in ``rules``, each a hash join on that many
    trailing labels of the host, broadcast where the rules are small.  Rules of any depth, wildcards and exceptions count."""
    labels = F.when(F.col(host) == "", 0).otherwise(F.size(F.split(host, r"\.")))
    ip = F.col(host).rlike(_IPV4) | F.contains(F.col(host), F.lit(":"))
    out = df.withColumns({"_labels": labels, "_ip": ip})
    for d in rules.depths:
        side = rules.table.filter(F.col("match_labels") == d).select(
            F.col("match_text").alias(f"_m{d}"), F.col("plain").alias(f"_r{d}"), F.col("wild").alias(f"_w{d}"), F.col("exception").alias(f"_x{d}"))
        side = F.broadcast(side) if rules.small else side
        key = F.when((F.col("_labels") >= d) & ~F.col("_ip"), F.substring_index(F.col(host), ".", -d))
        out = out.join(side, key == F.col(f"_m{d}"), "left")
    none = F.lit(None).cast("int")
    exception = F.greatest(none, none, *[F.col(f"_x{d}") for d in rules.depths])
    longest = F.greatest(F.lit(0), F.lit(0), *[F.col(f"_r{d}") for d in rules.depths], *[F.when(F.col(f"_w{d}") <= F.col("_labels"), F.col(f"_w{d}")) for d in rules.depths])
    n = F.coalesce(exception, longest)
    out = out.withColumn("suffix_labels", n)
    out = out.drop(*[f"_{p}{d}" for d in rules.depths for p in "mrwx"])
    tail = F.expr(f"if(suffix_labels = 0, '', substring_index({host}, '.', -suffix_labels))")
    has_domain = (F.col("suffix_labels") > 0) & (F.col("_labels") > F.col("suffix_labels"))
    out = out.withColumns({
        "public_suffix": tail,
        "_registered": F.when(has_domain, F.expr(f"substring_index({host}, '.', -(suffix_labels + 1))")).otherwise(""),
    })
    return out.withColumns({
        "registrable_domain": F.when(F.col("_registered") != "", F.col("_registered")).otherwise(
            F.substring_index(F.col(host), ":", 1)),
        "feature_domain": F.when(F.col("_registered") != "", F.col("_registered")).otherwise(F.col(host)),
        "subdomain_depth": F.when(F.col("_ip") | (F.col("_labels") == 0), 0)
        .when(F.col("suffix_labels") == 0, F.col("_labels") - 1)
        .otherwise(F.greatest(F.col("_labels") - F.col("suffix_labels") - 1, F.lit(0))),
    }).drop("_labels", "_ip", "_registered", "suffix_labels")


RESULT_COLUMNS = ["normalized_url", "host", "registrable_domain", "parse_status", "normalization_changed"]


def normalize_urls(df: DataFrame, rules: SuffixRules, raw: str = "raw_url", keep_fragment: bool = False) -> DataFrame:
    """Input columns plus the five result columns of the normaliser."""
    out = attach_suffix(normalize_steps(df, raw, keep_fragment), rules)
    return out.select(*df.columns, *RESULT_COLUMNS)


def _char_count(c: str) -> Column:
    v = F.col("normalized_url")
    return F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))


def feature_columns() -> dict[str, Column]:
    """The features over the columns left by normalize_steps(keep_fragment=True) + attach_suffix."""
    v, n = F.col("normalized_url"), F.length("normalized_url")
    digits = F.regexp_count(v, F.lit(f"[{_DIGITS}]"))
    letters = F.regexp_count(v, F.lit(r"\p{L}"))
    special = n - digits - letters
    domain = F.col("feature_domain")
    tokens = F.regexp_count(v, F.lit("[A-Za-z0-9]+"))
    # each character mapped to one of three marks, then marks whose neighbour differs
    marks = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(v, rf"[^\p{{L}}{_DIGITS}]", "-"), rf"[{_DIGITS}]", "0"), r"\p{L}", "a")
    length_of = lambda x: F.length(x)
    cols = {
        "url_length": n,
        "hostname_length": F.length("host"),
        "path_length": F.length("s_final_path"),
        "query_length": F.length("s_upper_query"),
        "fragment_length": F.length("s_final_fragment"),
        "digit_count": digits,
        "letter_count": letters,
        "special_char_count": special,
        "digit_ratio": ratio(digits, n),
        "letter_ratio": ratio(letters, n),
        "special_char_ratio": ratio(special, n),
        "dot_count": _char_count("."), "hyphen_count": _char_count("-"),
        "underscore_count": _char_count("_"), "slash_count": _char_count("/"),
        "question_mark_count": _char_count("?"), "equals_sign_count": _char_count("="),
        "percent_sign_count": _char_count("%"), "at_sign_count": _char_count("@"),
        "subdomain_depth": F.col("subdomain_depth"),
        "path_segment_count": F.regexp_count(F.col("s_final_path"), F.lit("[^/]+")),
        "query_parameter_count": F.regexp_count(F.col("s_upper_query"), F.lit("[^&]+")),
        "has_port": F.col("s_kept_port").isNotNull().cast("int"),
        "has_userinfo": F.contains(F.col("s_netloc"), F.lit("@")).cast("int"),
        "host_is_ip": (F.col("host").rlike(_IPV4) | F.col("host").rlike(_IPV6)).cast("int"),
        "tld_length": F.length("public_suffix"),
        "registrable_domain_length": F.length(domain),
        "domain_digit_ratio": ratio(F.regexp_count(domain, F.lit(f"[{_DIGITS}]")), F.length(domain)),
        "domain_hyphen_ratio": ratio(F.regexp_count(domain, F.lit("-")), F.length(domain)),
        "url_char_entropy": F.expr(
            "aggregate(filter(array_distinct(split(normalized_url, '')), x -> x <> ''), 0D, (a, c) -> a - "
            "((length(normalized_url) - length(replace(normalized_url, c, ''))) / length(normalized_url)) * "
            "log2((length(normalized_url) - length(replace(normalized_url, c, ''))) / length(normalized_url)))"),
        "longest_repeated_char_run": F.coalesce(F.array_max(F.transform(
            F.regexp_extract_all(v, F.lit(r"(?s)((.)\2*)"), F.lit(1)), length_of)), F.lit(0)),
        "char_type_transition_count": F.regexp_count(marks, F.lit(r"(.)(?!\1)(?=.)")),
        "token_count": tokens,
        "token_mean_length": ratio(F.regexp_count(v, F.lit("[A-Za-z0-9]")), tokens),
        "token_max_length": F.coalesce(F.array_max(F.transform(
            F.regexp_extract_all(v, F.lit("([A-Za-z0-9]+)"), F.lit(1)), length_of)), F.lit(0)),
    }
    kinds = dict(FEATURES)
    return {k: c.cast(kinds[k]).alias(k) for k, c in cols.items()}


def url_features(df: DataFrame, rules: SuffixRules, raw: str = "raw_url", names=None) -> DataFrame:
    """Input columns plus features for every row that parses; other rows go to ``reject_table``."""
    cols = feature_columns()
    steps = attach_suffix(normalize_steps(df, raw, keep_fragment=True), rules)
    return steps.filter(F.col("parse_status") == "ok").select(
        *df.columns, *[cols[n] for n in (names or FEATURE_NAMES)])


def feature_fingerprint(names=None) -> Column:
    """sha256 over a canonical text of the ordered vector: integers as they are, doubles in units of 1e-9."""
    kinds = dict(FEATURES)
    parts = [
        F.col(n).cast("string") if kinds[n] == "int" else F.round(F.col(n) * 1e9).cast("long").cast("string")
        for n in (names or FEATURE_NAMES)
    ]
    return sha256(F.concat_ws(",", *parts))
