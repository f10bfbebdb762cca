"""Tokens and terms of work descriptions, as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of two or more word characters of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The public English stop-word list of common text vectorizers, in
# alphabetical order. Words that no token can equal (one letter, apostrophe) are absent.
STOP_WORDS = """
    about above across after afterwards again against all almost alone along already
    also although always am among amongst amoungst amount an and another any anyhow
    anyone anything anyway anywhere are around as at back be became because become
    becomes becoming been before beforehand behind being below beside besides
    between beyond bill both bottom but by call can cannot cant co con could couldnt
    cry de describe detail do done down due during each eg eight either eleven else
    elsewhere empty enough etc even ever every everyone everything everywhere except
    few fifteen fifty fill find fire first five for former formerly forty found four
    from front full further get give go had has hasnt have he hence her here
    hereafter hereby herein hereupon hers herself him himself his how however
    hundred ie if in inc indeed interest into is it its itself keep last latter
    latterly least less ltd made many may me meanwhile might mill mine more moreover
    most mostly move much must my myself name namely neither never nevertheless next
    nine no nobody none noone nor not nothing now nowhere of off often on once one
    only onto or other others otherwise our ours ourselves out over own part per
    perhaps please put rather re same see seem seemed seeming seems serious several
    she should show side since sincere six sixty so some somehow someone something
    sometime sometimes somewhere still such system take ten than that the their them
    themselves then thence there thereafter thereby therefore therein thereupon
    these they thick thin third this those though three through throughout thru thus
    to together too top toward towards twelve twenty two un under until up upon us
    very via was we well were what whatever when whence whenever where whereafter
    whereas whereby wherein whereupon wherever whether which while whither who
    whoever whole whom whose why will with within without would yet you your yours
    yourself yourselves
""".split()


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.coalesce(text, F.lit(""))))


def word_tokens(text: Column, stop_words: list[str]) -> Column:
    """Tokens of the whole text in order, stop words left out."""
    tokens = F.regexp_extract_all(normalised(text), F.lit(TOKEN_PATTERN), F.lit(0))
    if not stop_words:
        return tokens
    # a long literal list becomes a hash lookup per token, not a scan of the list
    return F.filter(tokens, lambda word: ~word.isin(stop_words))


def one_and_two_grams(words: Column) -> Column:
    """The words, and each two neighbours joined by a space."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(
        words,
        F.zip_with(
            F.slice(words, F.lit(1), pairs),
            F.slice(words, F.lit(2), pairs),
            lambda left, right: F.concat_ws(" ", left, right),
        ),
    )
