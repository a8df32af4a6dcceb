"""Rule classifiers over names, titles, genres and markets as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import vocab
from encore.functions.columns import _c

CJK = "[一-鿿]"
# A character that is no part of a word, also next to letters with diacritics.
NO_WORD = r"[^\p{L}\p{N}_]"


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """Number of listed words that occur in the text as substrings."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def classify_by_name(
    name: str | Column,
    indicators: Sequence[str] = vocab.VI_INDICATORS,
    letters: str = vocab.VI_LETTERS,
    hit: str = "vietnamese",
    miss: str = "western",
) -> Column:
    low = F.lower(_c(name))
    return (
        F.when(low.isNull(), "unknown")
        .when(contains_any(low, indicators) | low.rlike(f"[{letters}]"), hit)
        .otherwise(miss)
    )


def pattern_hit_score(text: str | Column) -> Column:
    """Share of nine pattern groups found: seven letter groups, two name lists.

    The text is reduced to its non-ASCII letters once; the letter groups look at
    that rest only. The rare full names are searched as plain substrings before
    their word edges are checked.
    """
    low = F.lower(_c(text))
    rest = F.regexp_replace(low, r"[\x00-\x7F]+", "")
    groups = [vocab.VI_A, vocab.VI_E, vocab.VI_I, vocab.VI_O, vocab.VI_U, vocab.VI_Y, vocab.VI_D]
    hits = [rest.rlike(f"[{g}]") for g in groups]
    for names, gated in ((vocab.VI_FAMILY_NAMES, False), (vocab.VI_KNOWN_NAMES, True)):
        hit = low.rlike(f"(?:^|{NO_WORD})(?:{'|'.join(names)})(?:{NO_WORD}|$)")
        hits.append(contains_any(low, names) & hit if gated else hit)
    total = sum((h.cast("int") for h in hits), F.lit(0))
    return F.coalesce(total, F.lit(0)) / len(hits)


def genre_share(genres: str | Column, vocabulary: Sequence[str]) -> Column:
    """Share of the genres that contain any vocabulary term."""
    g = F.transform(_c(genres), lambda x: F.lower(x))
    hits = F.filter(g, lambda x: contains_any(x, vocabulary))
    return F.when(F.size(g) > 0, F.size(hits) / F.size(g)).otherwise(F.lit(0.0))


def market_scores(markets: str | Column) -> tuple[Column, Column]:
    m = F.coalesce(_c(markets), F.array().cast("array<string>"))
    asian = F.size(F.array_intersect(m, F.array(*[F.lit(x) for x in vocab.ASIAN_MARKETS])))
    west = F.size(F.array_intersect(m, F.array(*[F.lit(x) for x in vocab.WESTERN_MARKETS])))
    home = F.when(F.array_contains(m, "VN"), 0.8).otherwise(0.0) + F.when(asian >= 3, 0.3).otherwise(0.0)
    return home, west / len(vocab.WESTERN_MARKETS)


def add_culture_scores(
    df: DataFrame,
    artist: str | Column,
    track: str | Column,
    genres: str | Column,
    markets: str | Column,
    vocabularies: tuple[Sequence[str], Sequence[str], Sequence[str]] = (
        vocab.VI_GENRES,
        vocab.WESTERN_GENRES,
        vocab.BRIDGE_GENRES,
    ),
    w_ling: float = 0.3,
    w_genre: float = 0.4,
    w_market: float = 0.3,
) -> DataFrame:
    """Adds the three normalised scores, the dominant label and its score.

    Built in steps, so that each regex runs once per row.
    """
    home, west = market_scores(markets)
    v, w, b = F.col("vietnamese_score"), F.col("western_score"), F.col("bridge_score")
    scored = (
        df.withColumn("__ling", (pattern_hit_score(artist) + pattern_hit_score(track)) / 2)
        .withColumns({f"__g{i}": genre_share(genres, words) for i, words in enumerate(vocabularies)})
        .withColumns(
            {
                "vietnamese_score": w_ling * F.col("__ling") + w_genre * F.col("__g0") + w_market * home,
                "western_score": w_genre * F.col("__g1") + w_market * west,
            }
        )
        .withColumn("bridge_score", w_genre * F.col("__g2") + 0.5 * F.least(v, w))
        .withColumn("__sum", F.when(v + w + b > 0, v + w + b).otherwise(F.lit(1.0)))
    )
    names = ["vietnamese_score", "western_score", "bridge_score"]
    top = F.greatest(v, w, b)
    dominant = F.when(v == top, "vietnamese").when(w == top, "western").otherwise("bridge")
    return (
        scored.withColumns({n: F.col(n) / F.col("__sum") for n in names})
        .withColumns({"dominant_culture": dominant, "confidence": top})
        .drop("__ling", "__g0", "__g1", "__g2", "__sum")
    )


def regex_flags(name: str | Column) -> Column:
    """Struct of 0/1 scores from name patterns, label in the order unknown, V, W, bridge."""
    n = _c(name)
    is_v = F.coalesce(
        n.rlike("(?iu)(" + "|".join(vocab.VI_PATTERN_ARTISTS) + ")") | n.rlike(f"(?iu)[{vocab.VI_LETTERS}]"), F.lit(False)
    )
    ascii_only = n.rlike(r"^[a-zA-Z0-9\s&.\-']+$")
    is_w = F.coalesce(
        n.rlike("(?iu)(" + "|".join(vocab.WESTERN_PATTERN_ARTISTS) + ")") | (ascii_only & ~is_v), F.lit(False)
    )
    v, w = is_v.cast("double"), is_w.cast("double")
    label = F.when(is_v & is_w, "bridge").when(is_w, "western").when(is_v, "vietnamese").otherwise("unknown")
    return F.struct(
        v.alias("vietnamese_score"),
        w.alias("western_score"),
        F.when(is_v & is_w, 0.5).otherwise(0.0).alias("bridge_score"),
        label.alias("dominant_culture"),
        F.when(is_v | is_w, F.greatest(v, w)).otherwise(0.1).alias("cultural_confidence"),
    )


def _vote(v: Column, w: Column, c: Column, bound: float) -> Column:
    label = F.when(v > bound, "vietnamese").when(w > bound, "western").when(c > bound, "chinese").otherwise("mixed")
    return F.struct(
        v.alias("vietnamese_score"), w.alias("western_score"), c.alias("chinese_score"), label.alias("classification")
    )


def keyword_votes(artist: str | Column, track: str | Column) -> Column:
    """Artist list hit first, else word counts in the title; baselines, then normalised."""
    a, t = F.lower(_c(artist)), F.lower(_c(track))
    zero = F.lit(0.0)
    in_v, in_w, in_c = contains_any(a, vocab.VI_VOTE_ARTISTS), contains_any(a, vocab.WESTERN_VOTE_ARTISTS), a.rlike(CJK)
    listed = in_v | in_w | in_c
    words_v = F.least(F.lit(0.6), count_contained(t, vocab.VI_WORDS) * 0.2)
    words_w = F.least(F.lit(0.6), count_contained(t, vocab.EN_WORDS) * 0.1)
    v = F.when(in_v, 0.8).when(listed, zero).otherwise(words_v) + 0.2
    w = F.when(in_v, zero).when(in_w, 0.8).when(listed, zero).otherwise(words_w) + 0.2
    c = F.when(in_c & ~in_v & ~in_w, 0.8).otherwise(zero) + 0.1
    total = v + w + c
    return _vote(v / total, w / total, c / total, 0.45)


def keyword_votes_capped(artist: str | Column, track: str | Column) -> Column:
    """Independent votes per culture, each capped at 1, normalised or .33 each."""
    a, t = _c(artist), _c(track)
    low_a, low_t = F.lower(a), F.lower(t)
    cjk = F.length(F.regexp_replace(t, "[^一-鿿]", ""))

    def score(hit: Column, extra: Column) -> Column:
        return F.least(F.lit(1.0), F.when(hit, 0.7).otherwise(0.0) + F.least(F.lit(0.3), extra))

    v = score(contains_any(low_a, vocab.VI_CAPPED_ARTISTS), count_contained(low_t, vocab.VI_CAPPED_WORDS) * 0.1)
    w = score(contains_any(low_a, vocab.WESTERN_CAPPED_ARTISTS), count_contained(low_t, vocab.EN_CAPPED_WORDS) * 0.05)
    c = score(a.rlike(CJK) | contains_any(a, vocab.CHINESE_ARTISTS), cjk * 0.1)
    total = v + w + c
    norm = [F.when(total > 0, x / total).otherwise(0.33) for x in (v, w, c)]
    return _vote(*norm, 0.4)


def genre_string_vote(genres: str | Column) -> Column:
    g = F.lower(_c(genres))
    v = count_contained(g, vocab.VI_GENRE_PATTERNS)
    w = count_contained(g, vocab.WESTERN_GENRE_PATTERNS)
    c = count_contained(g, vocab.CHINESE_GENRE_PATTERNS)
    return (
        F.when(g.isNull(), "unknown")
        .when(v > F.greatest(w, c), "vietnamese")
        .when(w > F.greatest(v, c), "western")
        .when(c > 0, "chinese")
        .otherwise("other")
    )


def artist_hint(name: str | Column) -> Column:
    n = _c(name)
    return (
        F.when(contains_any(n, vocab.HINT_ARTISTS) | n.rlike(f"[{vocab.VI_LETTERS}]"), "vietnamese")
        .when(n.rlike(r"^[\x00-\x7F]*$"), "western")
        .otherwise("unknown")
    )
