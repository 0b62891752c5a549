"""Rules that a prompt states, sentence by sentence, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Cues, in the order in which they win; longer ones first within a class.
LABELS = ("constraint", "invariant", "non-negotiable", "nonnegotiable", "hard rule", "ground rule", "requirement:", "rule:")
PROHIBITIONS = (
    "without modifying", "without changing", "without touching", "must never", "should never", "no changes to", "must not", "cannot ", "can not ",
    "shouldn't", "should not", "don't ", "do not ", "never ", "can't ",
)
REQUIREMENTS = ("make sure", "has to ", "have to ", "needs to ", "must ", "always ", "preserve ", "maintain ", "keep ", "ensure ", "only use ", "stick to ")
REJECTIONS = ("rejected approach", "rejected workaround", "rejected fix", "rejected solution", "rejected route", "dead end", "dead-end")
#: A sentence with one of these is about now, not a rule.
TIME_SCOPED = (" yet", "for now", "right now", "at this point", "before we", "until ", " first,", " first.", " first ", "this turn", "next step")
CLASSES = (("labelled", LABELS), ("prohibition", PROHIBITIONS), ("requirement", REQUIREMENTS), ("rejection", REJECTIONS))
MOST_RULES, MOST_REJECTIONS = 3, 2


#: Words that point back, what they may point to, what makes a statement no decision, and what stands between a verb and a label.
POINTERS = "that this these those such it".split()
APPROACHES = "workaround approach fix change attempt route idea hack solution patch edit".split()
HEDGES = "if whether unless might may could would maybe perhaps possibly probably suppose supposing assuming previously historically originally formerly".split()
HEDGE_PHRASES = ("in case", "last year", "last time", "back then", "in the past", "years ago", "at the time", "used to")
FILLERS = "a an the considered definitely clearly now also already really basically simply just officially our my another".split()
LOOK_BACK, SHORTEST, LONGEST = 3, 12, 320


def paragraphs(s: Column) -> Column:
    """Sentences by paragraph: blank lines and list items part paragraphs, ends of sentences part sentences; code in fences is left out."""
    prose = F.regexp_replace(s, r"(?s)```.*?(?:```|\z)", "\n")
    parts = F.split(F.regexp_replace(prose, r"(?m)\n\s*\n|\n\s*(?=[-*+] |\d+[.)] )", "\u0001"), "\u0001")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
    return F.transform(parts, lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+"), bare), lambda x: x != ""))


def sentences(s: Column) -> Column:
    return F.flatten(paragraphs(s))


def unquoted(x: Column) -> Column:
    """Lower case, without what stands in quotes or code marks."""
    return F.regexp_replace(F.lower(x), r"`[^`]*`|\"[^\"]*\"", " ")


def words(low: Column) -> Column:
    return F.filter(F.split(low, "[^a-z0-9']+"), lambda w: w != "")


def rejection(paragraph: Column, k: Column, cue: Column) -> Column:
    """What a sentence (from 0) of a paragraph that carries a rejection label rejects, in the user's words; null if it asserts nothing.

    The label must open the sentence as a heading, or be said of something by ``is``, ``are``, ``as`` or ``'s``; questions, hedges, history and negations
    assert nothing. A subject that points back counts only if exactly one of the three sentences before names the kind of thing that it points to, and is
    quoted from there on.
    """
    text = F.get(paragraph, k)
    inside = lambda w, listed: w.isin(*listed)

    def judged(low: Column) -> Column:
        at = F.position(cue, low)
        parts = F.struct(at.alias("at"), words(F.substr(low, F.lit(1), at - 1)).alias("head"), F.ltrim(F.substr(low, at + F.char_length(cue))).alias("tail"), F.lower(text).alias("whole"))
        return let(parts, lambda p: asserted(low, p["at"], p["head"], p["tail"], p["whole"]))

    def asserted(low: Column, at: Column, head: Column, tail: Column, plain: Column) -> Column:
        hedged = F.exists(words(plain), lambda w: inside(w, HEDGES)) | plain.rlike("|".join(HEDGE_PHRASES))
        negated = F.exists(F.slice(F.reverse(head), 1, 5), lambda w: w.isin("not", "no", "never", "longer") | w.endswith("n't"))
        core = F.regexp_replace(F.array_join(head, " "), r"(?:(?:^| )(?:" + "|".join(FILLERS) + r"))+$", "")
        predicate = let(core, lambda c: let(F.substring_index(c, " ", -1), lambda verb: predicated(low, c, verb)))
        heading = let(words(tail), lambda t: F.when(tail.startswith(":") & (F.size(t) >= 2) & ~inside(F.get(t, F.lit(0)), POINTERS), text))
        return F.when((at > 0) & ~plain.endswith("?") & ~hedged & ~negated, F.when(F.size(head) == 0, heading).otherwise(predicate))

    def predicated(low: Column, core: Column, verb: Column) -> Column:
        said = verb.isin("is", "are", "as") | verb.endswith("'s")
        subject = F.trim(F.concat(F.regexp_replace(core, r"(?:^| )\S*$", ""), F.when(verb.endswith("'s"), F.concat(F.lit(" "), F.regexp_replace(verb, "'s$", ""))).otherwise("")))

        def told(subject: Column) -> Column:
            of = F.split(subject, " ")
            back = F.when(inside(F.get(of, F.lit(0)), POINTERS) | low.startswith("the above "), 0).when((verb == "as") & inside(F.get(of, F.lit(1)), POINTERS), 1)
            return F.when(subject != "", let(back, lambda k: F.when(k.isNull(), text).otherwise(let(of, lambda o: pointed(o, k)))))

        return F.when(said, let(subject, told))

    def pointed(of: Column, back: Column) -> Column:
        named = F.get(F.filter(F.slice(of, back + 2, 3), lambda w: inside(w, [*APPROACHES, *(f"{n}s" for n in APPROACHES)])), F.lit(0))
        return let(named, lambda w: let(F.when(inside(w, APPROACHES), w).otherwise(F.regexp_replace(w, "s$", "")), antecedent))

    def antecedent(noun: Column) -> Column:
        names = lambda x: ~x.endswith("?") & F.exists(words(unquoted(x)), lambda w: (w == noun) | (w == F.concat(noun, F.lit("s"))))
        before = F.filter(F.sequence(F.greatest(k - LOOK_BACK, F.lit(0)), F.greatest(k - 1, F.lit(0))), lambda j: (j < k) & names(F.get(paragraph, j)))
        whole = lambda b: F.array_join(F.slice(paragraph, F.get(b, F.lit(0)) + 1, k - F.get(b, F.lit(0)) + 1), " ")
        once = let(before, lambda b: F.when(F.size(b) == 1, let(whole(b), lambda x: F.when(F.char_length(x) <= LONGEST, x))))
        return F.when(noun.isNotNull(), once)

    return let(unquoted(text), judged)


def cue_pattern(*cues: str) -> str:
    return r"(?<![a-z])(?:" + "|".join(re.escape(c).replace("\\ ", " ") for c in cues) + ")"


def stated_rules(s: Column) -> Column:
    """array<struct<text, cue, kind>>: at most three rules and two rejections, in the order they are stated."""
    def one(paragraph: Column, x: Column, k: Column) -> Column:
        def found(low: Column) -> Column:
            first = None
            for name, cues in CLASSES:
                for c in cues:
                    hit, what = low.rlike(cue_pattern(c)), F.struct(F.lit(c.strip()).alias("cue"), F.lit(name).alias("kind"))
                    first = F.when(hit, what) if first is None else first.when(hit, what)
            some = low.rlike(cue_pattern(*[c for _, cues in CLASSES for c in cues]))  # most sentences have none
            now = low.rlike("|".join(re.escape(c) for c in TIME_SCOPED))
            return F.when(some & ~now, first)

        cue = F.when(F.char_length(x).between(SHORTEST, LONGEST), let(F.concat(unquoted(x), F.lit(" ")), found))
        return let(cue, lambda r: F.struct(F.when(r["kind"] == "rejection", rejection(paragraph, k, r["cue"])).otherwise(x).alias("text"), r["cue"].alias("cue"), r["kind"].alias("kind")))

    by_paragraph = F.transform(paragraphs(s), lambda p: F.transform(p, lambda x, k: one(p, x, k)))
    found = F.filter(F.flatten(by_paragraph), lambda r: r["cue"].isNotNull() & r["text"].isNotNull())
    return let(found, lambda all_: F.concat(F.slice(F.filter(all_, lambda r: r["kind"] != "rejection"), 1, MOST_RULES), F.slice(F.filter(all_, lambda r: r["kind"] == "rejection"), 1, MOST_REJECTIONS)))
