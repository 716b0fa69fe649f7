"""Script and language of texts by code points and stop words."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.text_quality import head

MIN_CHARS, MIN_WORDS = 20, 3

# Code point ranges of the scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "CJK": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)],
    "Japanese Kana": [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Cyrillic": [(0x400, 0x4FF), (0x500, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F)],
    "Thai": [(0xE00, 0xE7F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
}

# The most frequent words of each language, in the order in which ties are
# settled. A fuller table can be given wherever ``profiles`` is a parameter.
LATIN_PROFILES = {
    "English": "the of and to a in is that for it with was are this from on as at be by have not or but you",
    "Spanish": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus",
    "French": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce avec",
    "German": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "Portuguese": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas ao",
    "Italian": "di e il la che è un a per in una sono mi del non della le con si da dei alla più anche come",
    "Dutch": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog door",
    "Swedish": "och i att det som en på är av för med den till inte har de om ett han men var jag sig från vi",
    "Norwegian": "og i det er på til som en å for av at med de ikke den har jeg om et men var han fra vi",
    "Danish": "og i at det er en til på de for af med som den der ikke har jeg et om men var han fra vi",
    "Finnish": "ja on ei se oli että hän mutta kun niin ovat olla joka myös kuin tai jos vain mitä nyt sen hänen ole sitä voi",
    "Polish": "i w nie na z do się to że jest jak ale po co tak od za o jego przez dla by tylko już ma",
    "Czech": "a se v na je že s z do i to jako ale pro tak by o k za jsem co jeho ve které po",
    "Hungarian": "a az és hogy nem is egy ez van meg csak volt már de ha mint el még vagy ki azt be kell lesz ezt",
    "Romanian": "și de la în a cu nu pe care este un o din mai să au ce pentru sunt că fi se lui fost prin după",
    "Turkish": "ve bir bu da de için ile çok gibi daha ama ne kadar olarak o var mi en sonra her ben olan değil ya ki",
}
OTHER_PROFILES = {"Cyrillic": ("Russian", "и в не на что он как это по но"), "Devanagari": ("Hindi", "के का में है की से को और पर यह"), "Arabic": ("Arabic", "في من على إلى أن هذا التي عن مع لا")}
UNKNOWN, LATIN_UNKNOWN, MIXED = "Unknown", "Latin (Unknown)", "Mixed Script"


def script_class(name: str) -> str:
    """A character class of the script's ranges, for Java and RE2."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS[name]) + "]"


def beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x7F]+", "")


def script_counts(text: Column, beyond: Column) -> dict[str, Column]:
    """Characters of each script: what is gone once its runs are taken out (no string is made for each character).

    Scripts that have no ASCII are counted in what is ``beyond`` it, a column
    of ``beyond_ascii(text)``, so that most texts are read once for all of them.
    """
    within = {name: text if min(SCRIPTS[name])[0] < 128 else beyond for name in SCRIPTS}
    return {name: (F.length(t) - F.length(F.regexp_replace(t, script_class(name) + "+", ""))).cast("long") for name, t in within.items()}


def _column(name: str) -> str:
    return "n_" + name.lower().replace(" ", "_")


def script_histogram(corpus: DataFrame) -> DataFrame:
    """id and the count of each script."""
    rows = corpus.select("id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("beyond", beyond_ascii(F.col("t")))
    return rows.select("id", *[c.alias(_column(n)) for n, c in script_counts(F.col("t"), F.col("beyond")).items()])


def latin_words(text: Column, max_chars: int | None = None) -> Column:
    return F.regexp_extract_all(F.lower(head(text, max_chars)), F.lit("[a-zA-Z\\x{C0}-\\x{24F}]+"), F.lit(0))


def votes(words: Column, profile: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*profile.split(" "))))


def _best(pairs: list[tuple[str, Column]], least: Column | int, other: str) -> Column:
    """The first name with the largest value, if that is ``least`` or more."""
    top = F.greatest(*[c for _, c in pairs], F.lit(0)) if len(pairs) > 1 else pairs[0][1]
    out = F.when(top < least, F.lit(other))
    for name, c in pairs:
        out = out.when(c == top, F.lit(name))
    return out.otherwise(other)


def detect(corpus: DataFrame, profiles: Mapping[str, str] = LATIN_PROFILES, max_chars: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns to ``keep``, language, script, and the votes of the Latin profiles as an array in their order.

    Latin words are counted in the first ``max_chars`` characters, or in the
    whole text. Those in no profile go first, so that each profile looks at few.
    """
    rows = corpus.select("id", *keep, F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")).alias("t"))
    rows = rows.withColumn("beyond", beyond_ascii(F.col("t")))
    rows = rows.select("id", *keep, "t", *[c.alias(_column(n)) for n, c in script_counts(F.col("t"), F.col("beyond")).items()])
    n = {name: F.col(_column(name)) for name in SCRIPTS}
    total = sum(n.values(), F.lit(0).cast("long"))
    rows = rows.withColumn("total", total)
    top = F.greatest(*n.values())
    # ties go to the script that comes first in the text
    place = {name: F.when((c == top) & (c > 0), F.regexp_instr("t", F.lit(script_class(name)))) for name, c in n.items()}
    first = F.least(*place.values())
    script = None
    for name in SCRIPTS:
        script = F.when(place[name] == first, name) if script is None else script.when(place[name] == first, name)
    rows = rows.withColumn("dominant", script).withColumn("share", top / F.nullif("total", F.lit(0)))
    some = sorted({w for p in profiles.values() for w in p.split(" ")})
    rows = rows.withColumn("words", F.when(F.col("dominant") == "Latin", F.filter(latin_words(F.col("t"), max_chars), lambda w: w.isin(*some))))
    rows = rows.withColumn("latin_votes", F.array(*[F.coalesce(votes(F.col("words"), p), F.lit(0)) for p in profiles.values()]))
    latin = _best([(name, F.col("latin_votes")[k]) for k, name in enumerate(profiles)], MIN_WORDS, LATIN_UNKNOWN)
    other = F.col("dominant")
    for s, (name, profile) in OTHER_PROFILES.items():
        own = votes(F.split(F.lower("t"), "[^\\p{L}\\p{M}]+"), profile)
        other = F.when(F.col("dominant") == s, F.when(own >= MIN_WORDS, name).otherwise(s)).otherwise(other)
    asian = F.when(n["Japanese Kana"] > 0, "Japanese").when(n["Hangul"] > 0, "Korean").otherwise("CJK")
    language = (
        F.when(F.length("t") < MIN_CHARS, UNKNOWN).when(F.col("total") == 0, UNKNOWN).when(F.col("share") < 0.5, MIXED)
        .when(F.col("dominant").isin("CJK", "Japanese Kana"), asian).when(F.col("dominant") == "Hangul", "Korean").when(F.col("dominant") == "Latin", latin).otherwise(other)
    )
    shown = F.when((F.length("t") < MIN_CHARS) | (F.col("total") == 0), UNKNOWN).when(F.col("share") < 0.5, MIXED).otherwise(F.col("dominant"))
    # out of a generator, so that filters on the result stay above it (the optimizer would otherwise take the nested cases apart)
    return rows.select("id", *keep, F.inline(F.array(F.struct(language.alias("language"), shown.alias("script"), F.col("latin_votes").alias("latin_votes")))))


def refine(detected: DataFrame, corpus: DataFrame, model: Callable[[str], str | None], max_chars: int | None = None) -> DataFrame:
    """Asks a model (text to name or None) about texts that the profiles leave open: unknown Latin, and scripts shown by their name."""
    open_ = (F.col("language") == LATIN_UNKNOWN) | ((F.col("language") == F.col("script")) & ~F.col("language").isin(UNKNOWN, MIXED))
    ask = F.pandas_udf(lambda s: s.map(lambda t: model(t) if t else None), "string")
    # no filter on the detected columns: the optimizer would derive conditions from all of detect() through it
    texts = corpus.select("id", head(F.col("text"), max_chars).alias("__t"))
    named = detected.join(texts, "id", "left").withColumn("__named", ask(F.when(open_, F.col("__t"))))
    return named.withColumn("language", F.coalesce("__named", "language")).drop("__named", "__t")


def correct_by_prior(detected: DataFrame, profiles: Mapping[str, str] = LATIN_PROFILES) -> DataFrame:
    """Texts of unknown language take the corpus's, where one language has half of all texts.

    ``detected`` is read twice and should be cheap to read (a table, persisted or cut).
    """
    vague = [UNKNOWN, LATIN_UNKNOWN, MIXED]
    per = detected.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    known = [*profiles, *[n for n, _ in OTHER_PROFILES.values()], "Japanese", "Korean"]
    most = F.max(F.when(~F.col("language").isin(*vague), F.struct(F.col("n"), F.col("language"))))
    prior = per.agg(most.alias("m"), F.sum("n").alias("total")).select(F.when((F.col("m.n") / F.col("total") >= 0.5) & F.col("m.language").isin(*known), F.col("m.language")).alias("prior"))
    joined = detected.crossJoin(F.broadcast(prior))  # one row
    return joined.withColumn("language", F.when(F.col("language").isin(UNKNOWN, LATIN_UNKNOWN), F.coalesce("prior", "language")).otherwise(F.col("language"))).drop("prior")


def distribution(detected: DataFrame, column: str = "language") -> DataFrame:
    return detected.groupBy(column).agg(F.count(F.lit(1)).alias("n_files"))
