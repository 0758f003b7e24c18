"""Word forms from inflection rules, and the paradigms that fit a word.

A paradigm is (name, definition): an array of rows ``row, rules, heading, tagg, prescript, postscript, extra``. The
rules of a row are a chain of steps that rewrite the word from left to right. Each step is a substitution, so a chain
is folded over the word with built-in expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import bind
from foliant.session import materialise

DEFINITION = (
    "array<struct<row:double,rules:string,heading:string,tagg:string,prescript:string,postscript:string,extra:string>>"
)

# Letters and vowel changes the steps use.
VOWELS = "aouåeiyäö"
CONSONANTS = "bcdfghjklmnpqrstvwxz"
UMLAUT_FROM, UMLAUT_TO = "aouåy", "äööäö"
DROPPED_J = (("gju", "gu"), ("skju", "sku"), ("stjä", "stä"))

# Kinds of multi-word verbs.
PARTICLE_VERB, REFLEXIVE_VERB = "partikelverb", "reflexivt_verb"


class _Step:
    """The named steps, as substitutions on a word column."""

    @staticmethod
    def drop_last(word: Column, letters: str | None = None) -> Column:
        """Remove the last letter (if it is one of ``letters``); impossible on an empty word."""
        pattern = r"(?s).$" if letters is None else f"[{letters}]$"
        return F.when(F.length(word) > 0, F.regexp_replace(word, pattern, ""))

    @staticmethod
    def change_last(word: Column, letters: str, new: Column) -> Column:
        """Put ``new`` for the last occurrence of any of ``letters``."""
        pattern = f"(?s)^(.*)[{letters}]([^{letters}]*)$"
        changed = F.concat(F.regexp_extract(word, pattern, 1), new, F.regexp_extract(word, pattern, 2))
        return F.when(F.rlike(word, F.lit(f"[{letters}]")), changed).otherwise(word)

    @staticmethod
    def umlaut(word: Column) -> Column:
        last = F.regexp_extract(word, f"(?s)([{UMLAUT_FROM}])[^{UMLAUT_FROM}]*$", 1)
        return _Step.change_last(word, UMLAUT_FROM, F.translate(last, UMLAUT_FROM, UMLAUT_TO))

    @staticmethod
    def drop_vowel(word: Column) -> Column:
        """Remove the vowel before the last letter, and one m of a double m then left before it; a word's only
        vowel stays."""
        several = F.length(F.regexp_replace(word, f"[^{VOWELS}]", "")) > 1
        fits = F.rlike(word, F.lit("(?s)[aeiouy].$"))
        shorter = F.regexp_replace(F.regexp_replace(word, "(?s)[aeiouy](.)$", "$1"), "(?s)mm(.)$", "m$1")
        return F.when(several & fits, shorter).otherwise(word)

    @staticmethod
    def double(word: Column) -> Column:
        doubled = F.regexp_replace(F.regexp_replace(word, "k$", "ck"), f"([{CONSONANTS.replace('k', '')}])$", "$1$1")
        return F.when(F.length(word) > 0, doubled)

    @staticmethod
    def single(word: Column) -> Column:
        return F.regexp_replace(word, r"(?s)^(.*)([mnr])\2", "$1$2")

    @staticmethod
    def drop_j(word: Column) -> Column:
        for old, new in DROPPED_J:
            word = F.replace(word, F.lit(old), F.lit(new))
        return word

    @staticmethod
    def genitive(word: Column, ending: str) -> Column:
        ended = F.when(F.rlike(word, F.lit("[sxzSXZ]$")), word).otherwise(F.concat(word, F.lit(ending)))
        return F.when(F.length(word) > 0, ended)


def _apply(word: Column, step: Column) -> Column:
    drop = _Step.drop_last
    named = {
        "%sp": drop(word),
        "%sk": drop(word, CONSONANTS),
        "%sv": drop(word, VOWELS),
        "%ts": drop(drop(word)),
        "%ss": drop(word, "s"),
        "%fv": _Step.drop_vowel(word),
        "%dk": _Step.double(word),
        "%ek": _Step.single(word),
        "%om": _Step.umlaut(word),
        "%tj": F.regexp_replace(word, "(?s)^(.*)g", "$1gj"),
        "%ej": _Step.drop_j(word),
        "%asc": _Step.genitive(word, "s"),
        "%ascc": _Step.genitive(word, ":s"),
    }
    out = F.when(step == "=", word).when(
        F.startswith(step, F.lit("+")), F.concat(word, F.replace(F.substring(step, 2, 1 << 30), F.lit("/"), F.lit("")))
    )
    # %av and a letter: that letter for the last vowel
    out = out.when(F.startswith(step, F.lit("%av")), _Step.change_last(word, VOWELS, F.substring(step, 4, 1)))
    for name, value in named.items():
        out = out.when(step == name, value)
    return out.when(~F.rlike(step, F.lit("[%+=]")), step)


STEP = r"=|[%+][^%+=]*|[^%+=]+"


def apply_rules(word: Column, rules: Column) -> Column:
    """The word after all steps of a rule chain; null when a step is impossible. A chain without any step marker is
    the form itself."""
    steps = F.regexp_extract_all(rules, F.lit(STEP), F.lit(0))
    return F.aggregate(steps, word, lambda w, s: _apply(w, s))


FORM = "struct<heading:string,linenumber:double,prescript:string,form:string,tag:string,postscript:string,extra:string>"


def forms(lemma: Column, kind: Column, definition: Column) -> Column:
    """All forms a paradigm gives a word, in definition order: array of (heading, linenumber, prescript, form, tag,
    postscript, extra). A form is null where a step of its rules is impossible.

    Of a particle or reflexive verb the first word is inflected; the others follow it, or are put before it in
    participles. Reflexive verbs have no participles, passives or imperatives.
    """
    multi = F.coalesce(kind.isin(PARTICLE_VERB, REFLEXIVE_VERB), F.lit(False))
    words = F.split(lemma, " ")
    head = F.when(multi, F.get(words, F.lit(0))).otherwise(lemma)
    particles = F.when(multi, F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    reflexive = F.coalesce(kind == REFLEXIVE_VERB, F.lit(False)) | F.array_contains(particles, "sig")

    def skipped(d: Column) -> Column:
        tag = d.getField("tagg")
        return F.rlike(tag, F.lit("^(?:AP0|AF0)|P$")) | (tag == "V0M0A")

    def one(d: Column) -> Column:
        plain = apply_rules(head, d.getField("rules"))
        glued = F.array_join(particles, "")
        # a prefix that would give three equal letters in a row loses one
        clash = (F.length(glued) > 1) & (F.right(glued, F.lit(2)) == F.repeat(F.left(plain, F.lit(1)), F.lit(2)))
        prefix = F.when(clash, F.left(glued, F.length(glued) - 1)).otherwise(glued)
        participle = F.contains(d.getField("heading"), F.lit("particip"))
        form = (
            F.when(F.size(particles) == 0, plain)
            .when(participle, F.concat(prefix, plain))
            .when(plain.isNotNull(), F.array_join(F.concat(F.array(plain), particles), " "))
        )
        return F.struct(
            d.getField("heading").alias("heading"),
            d.getField("row").alias("linenumber"),
            d.getField("prescript").alias("prescript"),
            form.alias("form"),
            d.getField("tagg").alias("tag"),
            d.getField("postscript").alias("postscript"),
            d.getField("extra").alias("extra"),
        )

    rows = F.filter(F.coalesce(definition, F.array().cast(DEFINITION)), lambda d: ~(reflexive & F.coalesce(skipped(d), F.lit(False))))
    return F.transform(rows, one)


ROW = (
    "struct<linenumber:double,preform:array<struct<prescript:string,form:string,tag:string>>,"
    "postscript:string,extra:string>"
)


def table(all_forms: Column) -> Column:
    """Forms grouped by heading and line, headings in order of first use: the inflection table. Neighbouring forms
    of one heading and line share a row."""

    def line_numbers(own: Column) -> Column:
        """The forms of one heading, each with the number of the row it belongs to."""

        def step(acc: Column, f: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            same = last.getField("f").getField("linenumber").eqNullSafe(f.getField("linenumber"))
            number = F.coalesce(last.getField("line") + F.when(same, 0).otherwise(1), F.lit(0))
            return F.concat(acc, F.array(F.struct(f.alias("f"), number.alias("line"))))

        return F.aggregate(own, F.array().cast(f"array<struct<f:{FORM},line:int>>"), step)

    def row(numbered: Column, first: Column) -> Column:
        same = F.filter(numbered, lambda x: x.getField("line") == first.getField("line"))
        f = first.getField("f")
        preform = F.transform(
            same,
            lambda x: F.struct(
                x.getField("f").getField("prescript").alias("prescript"),
                x.getField("f").getField("form").alias("form"),
                x.getField("f").getField("tag").alias("tag"),
            ),
        )
        return F.struct(
            f.getField("linenumber").alias("linenumber"),
            preform.alias("preform"),
            f.getField("postscript").alias("postscript"),
            f.getField("extra").alias("extra"),
        )

    def rows(numbered: Column) -> Column:
        firsts = F.filter(
            numbered,
            lambda m, i: (i == 0) | (F.get(numbered, F.greatest(i - 1, F.lit(0))).getField("line") != m.getField("line")),
        )
        return F.transform(firsts, lambda m: row(numbered, m))

    def headings(made: Column) -> Column:
        names = F.array_distinct(F.transform(made, lambda f: f.getField("heading")))

        def one(name: Column) -> Column:
            own = F.filter(made, lambda f: f.getField("heading").eqNullSafe(name))
            return F.struct(name.alias("heading"), bind(line_numbers(own), rows).alias("rows"))

        return F.transform(names, one)

    return bind(all_forms, headings)


def _stored(paradigms: DataFrame) -> DataFrame:
    """Paradigms from files, whose size is known: a small table is sent to where the words are. By a shuffle all words of a
    paradigm would be inflected in one task."""
    return materialise(paradigms.select("name", "definition"), "paradigms")


def inflect(lemmas: DataFrame, paradigms: DataFrame) -> DataFrame:
    """``lemmas(lemma, paradigm, kind)`` with the forms of their paradigm ``paradigms(name, definition)``."""
    names = _stored(paradigms).select(F.col("name").alias("paradigm"), "definition")
    joined = lemmas.join(names, "paradigm")
    made = forms(F.col("lemma"), F.col("kind"), F.col("definition"))
    return joined.withColumn("forms", made).drop("definition")


def inflection_rows(inflected: DataFrame) -> DataFrame:
    """One row per form."""
    keys = [c for c in inflected.columns if c != "forms"]
    return inflected.select(*keys, F.posexplode("forms").alias("position", "f")).select(*keys, "position", "f.*")


# ---------------------------------------------------------------- matching paradigms

def conditions(text: str | None) -> list[tuple[str, str | None]]:
    """``wf1|tag1,wf2`` as (form, tag or None) pairs."""
    pairs = []
    for item in text.split(",") if text else []:
        form, _, tag = item.partition("|")
        pairs.append((form, tag if "|" in item else None))
    return pairs


def _condition_column(col: Column) -> Column:
    items = F.when(F.coalesce(F.length(col), F.lit(0)) > 0, F.split(col, ",")).otherwise(F.array().cast("array<string>"))
    return F.transform(items, lambda i: F.split(i, r"\|"))


def fits(all_forms: Column, include: Column, exclude: Column) -> Column:
    """Whether a table has every included (form[, tag]) and none of the excluded; a table with an impossible form
    never fits."""
    plain = F.transform(all_forms, lambda f: f.getField("form"))
    tagged = F.transform(all_forms, lambda f: F.array(f.getField("form"), f.getField("tag")))

    def has(condition: Column) -> Column:
        simple = F.coalesce(F.array_contains(plain, F.get(condition, F.lit(0))), F.lit(False))
        return F.when(F.size(condition) > 1, F.coalesce(F.array_contains(tagged, condition), F.lit(False))).otherwise(simple)

    possible = F.forall(all_forms, lambda f: f.getField("form").isNotNull())
    wanted = F.forall(_condition_column(include), has)
    unwanted = F.exists(_condition_column(exclude), has)
    return F.coalesce(possible & wanted & ~unwanted, F.lit(False))


def stem_index(paradigms: DataFrame) -> DataFrame:
    """(change, ending, tag, name): every rule chain once, as the change it makes to a stem and the ending it adds then.

    The ending is what the steps after the last one that is no addition put on; the change is everything before it. A
    chain of additions only has no change, and one that is a form itself has that form as its change.
    """
    rows = paradigms.select("name", F.explode("definition").alias("d"))
    steps = F.filter(F.regexp_extract_all("d.rules", F.lit(STEP), F.lit(0)), lambda s: s != "=")
    adds = lambda s: F.startswith(s, F.lit("+"))

    def split(all_steps: Column) -> Column:
        last = F.array_max(F.transform(all_steps, lambda s, i: F.when(~adds(s), i + 1).otherwise(0)))
        count = F.coalesce(last, F.lit(0))
        ending = F.transform(F.slice(all_steps, count + 1, F.size(all_steps) + 1), lambda s: F.replace(F.substring(s, 2, 1 << 30), F.lit("/"), F.lit("")))
        return F.struct(F.array_join(F.slice(all_steps, 1, count), "").alias("change"), F.array_join(ending, "").alias("ending"))

    parts = rows.withColumn("p", bind(steps, split))
    return parts.select("p.change", "p.ending", F.col("d.tagg").alias("tag"), "name").distinct()


def _plain_forms(lemma: Column, kind: Column, form: Column) -> Column:
    """What the inflected word of a (multi-word) form can be."""
    particles = F.slice(F.split(lemma, " "), 2, F.greatest(F.size(F.split(lemma, " ")), F.lit(1)))
    multi = F.coalesce(kind.isin(PARTICLE_VERB, REFLEXIVE_VERB), F.lit(False)) & (F.size(particles) > 0)
    behind, glued = F.concat(F.lit(" "), F.array_join(particles, " ")), F.array_join(particles, "")
    cut = lambda start: F.substring(form, F.length(start) + 1, F.length(form))
    shorter = F.left(glued, F.length(glued) - 1)
    found = F.array(
        F.when(F.endswith(form, behind), F.left(form, F.length(form) - F.length(behind))),
        F.when(F.startswith(form, glued), cut(glued)),
        F.when(F.startswith(form, shorter), cut(shorter)),
    )
    return F.when(multi, F.array_distinct(F.array_compact(found))).otherwise(F.array(form))


def _candidates(lemmas: DataFrame, paradigms: DataFrame) -> DataFrame:
    """(_row, name): the paradigms that give the longest required form of each word, by equality on change and ending.

    A word is put through every change once; where the required form begins with the result, the rest is the ending.
    There are far fewer changes than paradigms, as they are made of a fixed set of steps.
    """
    index = materialise(stem_index(paradigms), "stems")
    changes = index.agg(F.collect_set("change")).scalar()
    wanted = F.filter(_condition_column(F.col("include")), lambda c: F.length(F.get(c, F.lit(0))) >= 0)
    longest = F.array_max(F.transform(wanted, lambda c: F.struct(F.length(F.get(c, F.lit(0))).alias("n"), F.get(c, F.lit(0)).alias("form"), F.get(c, F.lit(1)).alias("tag"))))
    asked = lemmas.select("_row", "lemma", "kind", longest.alias("c")).withColumn("_changes", changes)
    multi = F.coalesce(F.col("kind").isin(PARTICLE_VERB, REFLEXIVE_VERB), F.lit(False))
    head = F.when(multi, F.get(F.split("lemma", " "), F.lit(0))).otherwise(F.col("lemma"))
    asked = asked.select("_row", head.alias("head"), F.col("c.tag").alias("tag"), F.explode(_plain_forms(F.col("lemma"), F.col("kind"), F.col("c.form"))).alias("form"), "_changes")
    stems = asked.withColumn("s", F.explode(F.transform("_changes", lambda x: F.struct(x.alias("change"), apply_rules(F.col("head"), x).alias("stem")))))
    stems = stems.filter(F.startswith("form", F.col("s.stem")))
    keyed = stems.select("_row", "tag", F.col("s.change").alias("change"), F.substring(F.col("form"), F.length("s.stem") + 1, F.length("form")).alias("ending"))
    index = index.withColumnRenamed("tag", "_tag")
    found = keyed.join(index, ["change", "ending"]).filter(F.col("tag").isNull() | (F.col("tag") == F.col("_tag")))
    return found.select("_row", "name").distinct()


def match_paradigms(lemmas: DataFrame, paradigms: DataFrame) -> DataFrame:
    """``lemmas(lemma, kind, include, exclude[, paradigm])`` with every paradigm that fits: (lemma, name, forms).

    With a ``paradigm`` the named one is tried. Otherwise a word is tried with the paradigms that can give its longest
    required form, found in the index of stems; only these are inflected in full and compared with all conditions. Words
    that require no form fit nearly every paradigm, and so meet all of them.
    """
    paradigms = _stored(paradigms)
    # forms are made once, however often the conditions look at them
    made = F.array(forms(F.col("lemma"), F.col("kind"), F.col("definition")))
    good = F.explode(F.filter(made, lambda f: fits(f, F.col("include"), F.col("exclude")))).alias("forms")
    if "paradigm" in lemmas.columns:
        tried = lemmas.join(paradigms.withColumnRenamed("name", "paradigm"), "paradigm")
        return tried.select("lemma", F.col("paradigm").alias("name"), good)
    lemmas = materialise(lemmas.select("lemma", "kind", "include", "exclude").withColumn("_row", F.monotonically_increasing_id()), "lemmas")
    requires = F.coalesce(F.length("include") > 0, F.lit(False))
    some = lemmas.filter(requires)
    pairs = some.join(_candidates(some, paradigms), "_row")
    # every paradigm is part of the answer for the others: one row per pair is what was asked for
    every = lemmas.filter(~requires).withColumn("name", F.explode(paradigms.agg(F.collect_set("name")).scalar()))
    # narrow rows, each worth much work: dealt to all tasks, whatever their size
    spark = lemmas.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tried = pairs.unionByName(every).repartition(tasks, "_row", "name").join(paradigms, "name")
    return tried.select("lemma", "name", good)


def parse_rules(rules: str) -> list[str]:
    """The steps of a rule chain, for looking at one by hand."""
    return re.findall(STEP, rules)
