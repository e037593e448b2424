"""Ranked matching of normalised records: containments, then rules on how many hold.

Normalised text is letters and digits with single spaces, so token membership
and token prefixes are containment of a padded string, and the whole score
stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_of, normalize_text, token_list
from ..options import ConfigurationError

#: Base scores, in the order in which the rules are tried.
PHONE, PHRASE, ALL, PREFIXES, PARTIAL, PREFIX_PARTIAL = 520, 500, 400, 300, 100, 70
PHRASE_TOKENS = 9
#: Names of the rules, in the same order.
MATCH_TYPES = ("phone", "phrase", "all_tokens", "prefix_tokens", "partial_tokens", "prefix_partial")
#: Fixed value: digits that make a pattern a telephone number.
PHONE_DIGITS = 7


@dataclass(frozen=True)
class SmartPattern:
    source: str
    normal: str
    tokens: tuple[str, ...]
    phone: str

    @property
    def has_phone(self) -> bool:
        return len(self.phone) >= PHONE_DIGITS


def compile_patterns(patterns: tuple[str, ...], case_sensitive: bool = False) -> tuple[SmartPattern, ...]:
    made = tuple(SmartPattern(p, normalize_text(p, case_sensitive), tuple(token_list(p, case_sensitive)), digits_of(p)) for p in patterns)
    if not made or not all(p.normal for p in made):
        raise ConfigurationError("smart patterns need a letter or digit")
    return made


def best_rows(df: DataFrame, patterns: tuple[SmartPattern, ...], normal: str = "_normal", digits: str = "_digits") -> DataFrame:
    """Matching rows with _best: struct(score, match_type, pattern) of the pattern that scores most, ties to the earliest.

    What a record holds of each token is a column of its own before the rules
    are tried, so that no rule repeats it: rules are arithmetic on a few
    Booleans, and the generated code stays small however many patterns there are.
    The filter refers to a row number so that the optimizer leaves it above
    these columns and does not put their expressions in its place.
    """
    words = list(dict.fromkeys(t for p in patterns for t in p.tokens))
    n, d = F.col(normal), F.col(digits)
    padded = df.withColumn("_padded", F.concat(F.lit(" "), n, F.lit(" ")))
    held = {f"_tok{k}": F.col("_padded").contains(f" {w} ") for k, w in enumerate(words)}
    held |= {f"_pre{k}": F.col("_padded").contains(f" {w}") for k, w in enumerate(words) if len(w) >= 2}
    held |= {f"_phrase{i}": n.contains(p.normal) for i, p in enumerate(patterns)}
    held |= {f"_phone{i}": d.contains(p.phone) for i, p in enumerate(patterns) if p.has_phone}
    at = {w: k for k, w in enumerate(words)}
    counts, rules, made = {}, {}, []
    for i, p in enumerate(patterns):
        one = lambda c: c.cast("int")
        full, starts = F.lit(0), F.lit(0)
        for t in p.tokens:
            full = full + one(F.col(f"_tok{at[t]}"))
            if len(t) >= 2:
                starts = starts + one(F.col(f"_pre{at[t]}") & ~F.col(f"_tok{at[t]}"))
        counts |= {f"_full{i}": full, f"_starts{i}": starts}
        f, s, k = F.col(f"_full{i}"), F.col(f"_starts{i}"), len(p.tokens)
        tests = [
            (F.col(f"_phone{i}") if p.has_phone else F.lit(False), F.lit(PHONE)),
            (F.col(f"_phrase{i}"), F.lit(PHRASE + min(k, PHRASE_TOKENS))),
            (f == k, ALL + f),
            ((f + s == k) & (f > 0), PREFIXES + f * 10 + s),
            (f > 0, PARTIAL + f * 10),
            (s > 0, PREFIX_PARTIAL + s),
        ]
        rule, score = F, F
        for r, (test, value) in enumerate(tests):
            rule, score = rule.when(test, F.lit(r)), score.when(test, value)
        rules |= {f"_rule{i}": rule, f"_score{i}": score}
        made.append(F.when(F.col(f"_score{i}").isNotNull(), F.struct(F.col(f"_score{i}").cast("int").alias("score"), F.lit(-i).alias("nth"), F.col(f"_rule{i}").alias("rule"))))
    scored = padded.withColumns(held).withColumns(counts).withColumns(rules).withColumns({"_top": made[0] if len(made) == 1 else F.greatest(*made), "_row": F.monotonically_increasing_id()})
    scored = scored.filter("_top IS NOT NULL AND _row >= 0")
    top = F.col("_top")
    kind = F.element_at(F.array(*map(F.lit, MATCH_TYPES)), top["rule"] + 1)
    source = F.element_at(F.array(*(F.lit(p.source) for p in patterns)), 1 - top["nth"])
    best = F.struct(top["score"].alias("score"), kind.alias("match_type"), source.alias("pattern"))
    return scored.select(*df.columns, best.alias("_best"))



def score_text(text: str, pattern: str, case_sensitive: bool = False) -> int:
    """The score of one record on the driver or in a UDF; 0 for no match."""
    (p,) = compile_patterns((pattern,), case_sensitive)
    normal = normalize_text(text, case_sensitive)
    padded = f" {normal} "
    full = sum(f" {t} " in padded for t in p.tokens)
    starts = sum(len(t) >= 2 and f" {t}" in padded and f" {t} " not in padded for t in p.tokens)
    n = len(p.tokens)
    rules = (
        (p.has_phone and p.phone in digits_of(text), PHONE), (p.normal in normal, PHRASE + min(n, PHRASE_TOKENS)), (full == n, ALL + full), (full + starts == n and full > 0, PREFIXES + full * 10 + starts),
        (full > 0, PARTIAL + full * 10), (starts > 0, PREFIX_PARTIAL + starts),
    )
    return next((score for test, score in rules if test), 0)
