"""Per-document text quality statistics, and rules on them that tell prose from lists, tables and junk.

Method: an ordered rule list induced by incremental reduced-error pruning on labelled documents, exported as one SQL CASE
expression over the statistics and applied natively to every document. Only the fit looks at a bounded sample.

The documents carry no labels of their kind. What the rules learn from are documents made from messages by known changes (see `labelled`), so
their labels owe nothing to the statistics; the rules see the statistics only, and decide all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm import labelled
from chatloom.session import settled

# Frequent pronouns, auxiliaries, conjunctions and particles of the seven languages.
GLUE = (
    "i you we he she it they is was are were be been have has had did do does will would can could should my your so if that what who and or but not "
    "no than when while until me us there then just about before "
    "que y no se me nos te es fue está si por para con como así mi su pero antes ya más "
    "que e não se me nos você é foi está por com como assim mas antes já mais eu ele ela a gente "
    "ich du wir er sie es ist war sind hat habe haben will und oder aber nicht dass wenn so als mir uns bevor "
    "je tu on nous vous il elle est était a ai et ou mais ne pas que qui si plus pour avant alors j'ai c'est "
    "है हैं था थी हूँ हो में से को का की के और मैं तुम हम ने कि तो भी नहीं पर क्या "
    "я ты мы он она это не и а но что как если в на с по за бы было уже до мне"
).split()
# Articles, determiners and prepositions, which need a noun after them.
NEEDY = "the a an this that these those his her our my of at in on to from el la los las un una der die das ein eine le les une des o os as um uma".split()


_CELL = r"[^\n,;|\t]{1,24}"
STATISTICS = [
    "n_words", "n_lines", "mean_word_length", "words_per_line", "letter_share", "digit_share", "symbol_share", "end_mark_share", "marks_per_word",
    "bullet_share", "speaker_share", "short_line_share", "tab_share", "semicolon_share", "pipe_share", "comma_share", "column_share", "number_share",
    "separator_rate", "common_word_share", "needy_pair_share", "repeat_share", "distinct_share", "cluster_share", "damage_share", "long_word_share",
]


def statistics(docs: DataFrame, text: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """`docs` with the columns of STATISTICS (DOUBLE), or those `wanted` alone, for which alone the text is searched. A null or blank text has zeros throughout; a column of `docs` named like one is replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    # only texts that hold the mark are searched for lines of it
    having = lambda mark, pattern: F.when(t.contains(mark), n(pattern)).otherwise(0.0)
    size = lambda kept: F.char_length(F.regexp_replace(t, rf"[^{kept}]+", "")).cast("double")
    base = {
        "_words": n(r"\S+"),
        "_lines": n(r"(?m)^.*\S.*$"),
        "_solid": F.char_length(F.regexp_replace(t, r"[\s\p{Z}]+", "")).cast("double"),
        "_letters": size(r"\p{L}\p{M}"),
        "_digits": size(r"\p{Nd}"),
        "_ends": n(r"(?m)[.!?।…][^\p{L}\p{N}\n]*$"),
        "_marks": n(r"[.!?।…]+(?=\s|$)"),
        "_bullets": n(r"(?m)^[ \t]*(?:[-–•*·▪]|\[[ xX]?\]|\(?\d{1,3}[.)])[ \t]+\S"),
        "_speakers": n(r"(?m)^[ \t]*(?:\[\d{1,2}[:.]\d{2}[^\]\n]{0,8}\][ \t]*)?\p{Lu}[\p{L}\p{M} .'-]{0,30}:[ \t]+\S+[ \t]+\S|(?m)^[ \t]*\[\d{1,2}[:.]\d{2}\]"),
        # what is possessive is tried once: no word is taken apart again where the rest of a line doesn't fit
        "_short": n(r"(?m)^[ \t]*+(?:\S++[ \t]++(?=\S)){0,4}+[^\s.!?।…]++(?<!:)[ \t]*+$"),
        "_tabs": having("\t", r"(?m)^[^\t\n]*+\t[^\n]*+$"),
        "_semis": having(";", r"(?m)^[^\n;]++;[^\n]*+$"),
        "_pipes": having("|", r"(?m)^[^\n|]*+\|[^\n]*+$"),
        "_commas": having(",", rf"(?m)^{_CELL}(?:, ?{_CELL}){{2,}}$"),
        "_columns": having("  ", r"(?m)^[^\n]*?\S {2,}+\S[^\n]*+$"),
        "_numbers": F.when(~t.rlike("[0-9]"), 0.0).otherwise(n(r"(?<![^\s,;|])[-+]?\d[\d.,:%/-]*(?![^\s,;|])")),
        "_separators": n(r" \| |; ?(?=\S)|\t"),
        "_clusters": n(r"[bcdfghjklmnpqrstvwxz]{5,}+[a-z]*+"),
        "_damage": n(r"\x{FFFD}|[ÃÂÐÑâà][\x{80}-\x{BF}€¤‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"),
        # cells of a row that are parted by marks alone are words of their own
        "_long": F.when(t.rlike(r"[^\s,;|]{26}"), n(r"[^\s,;|\p{So}\x{200D}\x{FE0F}]{26,}+")).otherwise(0.0),
    }
    # word by word: the form of each word is looked up, no pattern runs over the text for it
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}'’]+"), lambda w: w != "")
    w = F.col("_w")
    follows = lambda test: F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), test), lambda x: x)
    by_word = {
        "_tokens": F.size(w).cast("double"),
        "_common": F.size(F.filter(w, lambda x: x.isin(*GLUE))).cast("double"),
        "_needy": F.size(follows(lambda a, b: F.coalesce(a.isin(*NEEDY) & b.isin(*NEEDY), F.lit(False)))).cast("double"),
        "_repeats": F.size(follows(lambda a, b: F.coalesce(a == b, F.lit(False)))).cast("double"),
        "_distinct": F.size(F.array_distinct(w)).cast("double"),
    }
    parts = {
        "n_words": ["_words"], "n_lines": ["_lines"], "mean_word_length": ["_solid", "_words"], "words_per_line": ["_words", "_lines"], "letter_share": ["_letters", "_solid"],
        "digit_share": ["_digits", "_solid"], "symbol_share": ["_letters", "_digits", "_solid"], "end_mark_share": ["_ends", "_lines"], "marks_per_word": ["_marks", "_words"],
        "bullet_share": ["_bullets", "_lines"], "speaker_share": ["_speakers", "_lines"], "short_line_share": ["_short", "_lines"], "tab_share": ["_tabs", "_lines"],
        "semicolon_share": ["_semis", "_lines"], "pipe_share": ["_pipes", "_lines"], "comma_share": ["_commas", "_lines"], "column_share": ["_columns", "_lines"],
        "number_share": ["_numbers", "_words"], "separator_rate": ["_separators", "_words"], "common_word_share": ["_common", "_tokens"], "needy_pair_share": ["_needy", "_tokens"],
        "repeat_share": ["_repeats", "_tokens"], "distinct_share": ["_distinct", "_tokens"], "cluster_share": ["_clusters", "_words"], "damage_share": ["_damage", "_solid"],
        "long_word_share": ["_long", "_words"],
    }
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = {k: F.col(p[0]) if len(p) == 1 else per(*p) for k, p in parts.items() if len(p) < 3}
    out["symbol_share"] = F.when(F.col("_solid") > 0, 1 - (F.col("_letters") + F.col("_digits")) / F.col("_solid")).otherwise(0.0)
    wanted = STATISTICS if wanted is None else wanted
    kept = [c for c in docs.columns if c not in STATISTICS]
    used = {p for name in wanted for p in parts[name]}
    counted = {k: v for k, v in base.items() if k in used}
    out_of = docs
    if used & set(by_word):
        # the words once, then what is counted of them
        out_of = settled(out_of, {"_w": words})
        counted |= {k: v for k, v in by_word.items() if k in used}
    # two at a time: the loop over matches is generated code, and a method that holds many such loops is too large for the JVM to compile
    names = list(counted)
    for i in range(0, len(names), 2):
        out_of = settled(out_of, {k: counted[k] for k in names[i : i + 2]})
    return out_of.select(*kept, *[F.round(out[k], 6).alias(k) for k in wanted])


@dataclass(frozen=True)
class Test:
    column: int
    above: bool
    threshold: float

    def on(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.column] >= self.threshold if self.above else x[:, self.column] < self.threshold


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    kind: str

    def on(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for t in self.tests:
            hit &= t.on(x)
        return hit


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], most: int = 6) -> list[Test]:
    """Tests one by one by information gain until the rule covers no other kind."""
    tests: list[Test] = []
    inside = np.ones(len(x), dtype=bool)
    while len(tests) < most and (inside & ~y).any():
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        best, best_gain = None, 1e-9
        for j, at in enumerate(cuts):
            v = x[inside, j]
            pos, neg = np.sort(v[y[inside]]), np.sort(v[~y[inside]])
            below_p, below_n = np.searchsorted(pos, at), np.searchsorted(neg, at)
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best_gain:
                    best, best_gain = Test(j, above, float(at[k])), gain[k]
        if best is None:
            break
        tests.append(best)
        inside &= best.on(x)
    return tests


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = rule.on(x)
    p, n = (hit & y).sum(), (hit & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce_rules(x: np.ndarray, kinds: np.ndarray, order: tuple[str, ...] = ("table", "list", "junk"), seed: int = 7, thresholds: int = 128, least: float = 0.9, tries: int = 4) -> list[Rule]:
    """Ordered rules for the kinds in `order`; what none covers is of the remaining kind.

    Incremental reduced-error pruning: each rule grows on two thirds of what is left, loses its last tests while that doesn't
    make it worse on the other third, and is kept while its worth (p - n) / (p + n) there is above `least`.
    """
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(x), dtype=bool)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= thresholds else np.unique(np.quantile(middle, np.linspace(0, 1, thresholds))))
    for kind in order:
        failures = 0
        while (y := kinds == kind)[left].any() and failures < tries:
            at = rng.permutation(np.flatnonzero(left))
            # both parts hold the kind in proportion
            at = np.concatenate([at[y[at]], at[~y[at]]])
            prune_part = np.zeros(len(x), dtype=bool)
            prune_part[at[2::3]] = True
            grow_part = left & ~prune_part
            tests = _grow(x[grow_part], y[grow_part], cuts)
            if not tests:
                failures += 1
                continue
            rule = Rule(tuple(tests), kind)
            on = prune_part if (y & prune_part).any() else grow_part
            while len(rule.tests) > 1 and _worth(shorter := Rule(rule.tests[:-1], kind), x[on], y[on]) >= _worth(rule, x[on], y[on]):
                rule = shorter
            covered = rule.on(x) & left
            if _worth(rule, x[on], y[on]) <= least or not (covered & y).any():
                failures += 1  # another division may still give a rule
                continue
            rules.append(rule)
            left &= ~covered
    return rules


def to_case(rules: list[Rule], default: str = "prose") -> str:
    """The rules as one SQL CASE expression over the statistics."""
    lines = [" AND ".join(f"{STATISTICS[t.column]} {'>=' if t.above else '<'} {t.threshold:.8f}D" for t in r.tests) for r in rules]
    body = " ".join(f"WHEN {line} THEN '{r.kind}'" for line, r in zip(lines, rules, strict=True))
    return f"CASE {body} ELSE '{default}' END" if rules else f"'{default}'"


def fit_rules(stats: DataFrame, kind: str = "kind") -> list[Rule]:
    """Rules from labelled documents (STATISTICS and `kind`), all of which pass through the driver: the caller bounds their number."""
    got = stats.select(*STATISTICS, kind).toPandas().sort_values([*STATISTICS, kind])
    return induce_rules(got[STATISTICS].to_numpy(float), got[kind].to_numpy())


def learned_rules(messages: DataFrame, sample_rows: int = 4000, made: int = 10_000, seed: int = 11) -> list[Rule]:
    """Rules from `made` documents made from at most `sample_rows` messages; the fit alone is bounded. Without messages there are no rules."""
    spark = messages.sparkSession
    made_of = labelled.labelled_documents(labelled.sample_messages(messages, sample_rows), made, seed)
    return fit_rules(statistics(spark.createDataFrame(made_of, "text STRING, kind STRING"))) if made_of else []


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """`stats` with `kind`; a document without any words is judged by its zeros like any other."""
    return settled(stats, {"kind": F.expr(to_case(rules))})


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`docs` with `kind`, for which only the statistics that the rules name are counted."""
    named = {STATISTICS[t.column] for r in rules for t in r.tests}
    return classify(statistics(docs, text, [c for c in STATISTICS if c in named]), rules).drop(*named)
