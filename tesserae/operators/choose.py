"""Facet values that questions ask for, by score: an inverted index of the vocabulary, joined with the terms of all questions.

A value's terms are those of its name, and at a lower weight those of its description. A rare term tells more than one that
many values have, so each counts by its inverse frequency among values. A question's term that the vocabulary has meets that
term; any other meets the terms that are spelt alike, by the trigrams that they share. A value's score is the weighted part
of its terms that the question meets: 1 if it says all of them. What was said in earlier turns counts less by the turn.

Terms are looked up once for all questions that say them, whatever their number, and no question meets a value with which it
shares nothing. Turns meet the turns before them by number, so a long conversation is no task of its own.

Defined cases: a null text has no terms; a value without terms is never chosen; repeated values of a facet count once, with
the terms of all their descriptions; repeated ids of questions count as one question; an empty vocabulary chooses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.staging import staged

#: Weights of a term of a name and of a description; the least likeness of a term that is misspelt.
NAME, DESCRIPTION, ALIKE = 1.0, 0.25, 0.5
#: The least score of a value that is chosen, and most values of a question and facet.
LEAST, MOST = 0.5, 3
#: Decimals of a score, so that it doesn't depend on the order of sums.
DECIMALS = 6


def terms(text: Column) -> Column:
    """The distinct words of a text, in lower case: letters, digits and underscores."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), ""))


def trigrams(term: Column) -> Column:
    """The distinct stretches of three characters of a term with two blanks before it and one after."""
    padded = F.concat(F.lit("  "), term, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) + 1), lambda i: F.substring(padded, i, F.lit(3))))


@dataclass(frozen=True)
class VocabularyIndex:
    """postings: term, facet, value, part (of the value's weight); grams: gram, term, size (trigrams of the term)."""

    postings: DataFrame
    grams: DataFrame

    @staticmethod
    def of(vocabulary: DataFrame) -> VocabularyIndex:
        """vocabulary: facet, value, description. The index is written once, and read by every use."""
        said = vocabulary.select("facet", "value", F.explode(F.array(F.struct(F.lit(NAME).alias("w"), terms(F.col("value")).alias("t")), F.struct(F.lit(DESCRIPTION).alias("w"), terms(F.col("description")).alias("t")))).alias("s"))
        weighted = staged(said.select("facet", "value", "s.w", F.explode("s.t").alias("term")).groupBy("facet", "value", "term").agg(F.max("w").alias("w")), "weighted-terms")
        n = weighted.select("facet", "value").distinct().count()
        rare = weighted.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + F.lit(float(n)) / F.col("df")).alias("rare"))
        worth = weighted.join(rare, "term").select("term", "facet", "value", (F.col("w") * F.col("rare")).alias("worth"))
        whole = worth.groupBy("facet", "value").agg(F.sum("worth").alias("whole"))
        postings = worth.join(whole, ["facet", "value"]).select("term", "facet", "value", (F.col("worth") / F.col("whole")).alias("part"))
        spelt = weighted.select("term").distinct().select("term", trigrams(F.col("term")).alias("g"))
        return VocabularyIndex(staged(postings, "postings"), staged(spelt.select(F.explode("g").alias("gram"), "term", F.size("g").alias("size")), "trigrams"))

    def spellings(self, words: DataFrame) -> DataFrame:
        """word, term, alike: the vocabulary's terms that each word may stand for. words: word, distinct."""
        known = self.postings.select(F.col("term").alias("word")).distinct()
        same = words.join(known, "word").select("word", F.col("word").alias("term"), F.lit(1.0).alias("alike"))
        other = words.join(known, "word", "left_anti").select("word", trigrams(F.col("word")).alias("g"))
        spelt = other.select("word", F.size("g").alias("n"), F.explode("g").alias("gram"))
        # Terms that can be as alike as asked differ in length by a bounded factor.
        near = (F.col("n") * (2 - ALIKE) >= F.col("size") * ALIKE) & (F.col("size") * (2 - ALIKE) >= F.col("n") * ALIKE)
        shared = spelt.join(self.grams, "gram").where(near).groupBy("word", "term", "n", "size").agg(F.count("*").alias("shared"))
        alike = shared.select("word", "term", (2 * F.col("shared") / (F.col("n") + F.col("size"))).alias("alike"))
        return same.unionByName(alike.where(F.col("alike") >= ALIKE))

    def met(self, said: DataFrame, keys: list[str]) -> DataFrame:
        """keys, term, alike: the vocabulary's terms that are said. said: keys, word."""
        return said.join(self.spellings(said.select("word").distinct()), "word").select(*keys, "term", "alike")

    def chosen(self, met: DataFrame, keys: list[str], least: float, most: int) -> DataFrame:
        best = met.join(self.postings, "term").groupBy(*keys, "facet", "value", "term").agg(F.max(F.col("alike") * F.col("part")).alias("s"))
        scores = best.groupBy(*keys, "facet", "value").agg(F.round(F.sum("s"), DECIMALS).alias("score"))
        order = W.partitionBy(*keys, "facet").orderBy(F.desc("score"), "value")
        top = scores.where(F.col("score") >= least).withColumn("#rank", F.row_number().over(order)).where(F.col("#rank") <= most)
        lists = top.groupBy(*keys, "facet").agg(F.array_sort(F.collect_list(F.struct("#rank", "value", "score"))).alias("l"))
        return lists.select(*keys, "facet", F.transform("l", lambda x: x["value"]).alias("values"), F.transform("l", lambda x: x["score"]).alias("scores"))

    def choose(self, questions: DataFrame, keys: list[str], text: str = "text", least: float = LEAST, most: int = MOST) -> DataFrame:
        """keys, facet, values (best first, ties in order), scores: the values of each question and facet that score enough."""
        said = questions.select(*keys, F.explode(terms(F.col(text))).alias("word")).distinct()
        return self.chosen(self.met(said, keys), keys, least, most)

    def choose_in_turns(self, turns: DataFrame, asked: Column, back: int = 2, key: str = "conv_id", turn: str = "turn", text: str = "text", least: float = LEAST, most: int = MOST) -> DataFrame:
        """The same of the turns that are asked: what they say, and at half the likeness for each step what the turns numbered up
        to so many before say. Only what the vocabulary has goes on to later turns."""
        met = self.met(turns.select(key, turn, F.explode(terms(F.col(text))).alias("word")).distinct(), [key, turn])
        spread = met.withColumn("#step", F.explode(F.sequence(F.lit(0), F.lit(back))))
        spread = spread.select(key, (F.col(turn) + F.col("#step")).alias(turn), "term", (F.col("alike") * F.pow(F.lit(0.5), F.col("#step"))).alias("alike"))
        wanted = turns.where(asked).select(key, turn).distinct()
        return self.chosen(spread.join(wanted, [key, turn], "left_semi"), [key, turn], least, most)
