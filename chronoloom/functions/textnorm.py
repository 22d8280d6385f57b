"""Text normalisers and matchers, column in and column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First-person forms, location keywords, leading determiners, answer-letter patterns.
FIRST_PERSON = ("i", "me", "my", "myself", "mine")
LOCATIONS = {
    "kitchen": ["kitchen"],
    "bedroom": ["bedroom", "my room"],
    "living_room": ["living room", "sofa", "couch"],
    "dining": ["dining table", "dining room"],
    "bathroom": ["bathroom", "toilet", "shower"],
    "balcony": ["balcony", "terrace"],
    "desk": ["desk"],
    "garden": ["garden", "yard", "courtyard"],
    "stairs": ["stairs", "staircase", "second floor", "upstairs", "downstairs"],
    "entrance": ["entrance", "front door", "hallway"],
    "store": ["supermarket", "store", "shop", "market", "restaurant"],
    "street": ["street", "road", "sidewalk"],
}
DETERMINERS = ("the", "a", "an", "my", "his", "her", "their", "our", "your", "some", "this", "that", "these", "those")
STOP_FORMS = (
    "it", "them", "him", "her", "me", "you", "us", "they", "he", "she", "i", "one", "thing", "something", "anything", "everything",
    "someone", "everyone", "anyone", "nothing", "others", "we", "hand", "hands", "head", "hair", "face", "eyes", "arm", "arms", "leg",
    "legs", "foot", "feet", "body", "finger", "fingers", "time", "way", "bit", "lot", "part", "side", "end",
)
FRAGMENT_OPENERS = (
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "that", "if", "whether", "and", "but", "or", "so", "because",
    "in", "on", "at", "to", "from", "with", "for", "of", "about", "into", "onto", "over", "under", "near", "behind", "beside", "between",
    "through", "before", "after", "during", "against", "across", "around", "along", "towards", "toward", "upon", "within", "without",
    "off", "out", "up", "down", "back", "away", "there", "here", "then", "than", "as", "like",
)
EGO_SUBJECTS = ("i", "me")
MANIPULATIONS = (
    "hold", "holds", "holding", "hold up", "holds up", "pick up", "picks up", "picked up", "picking up", "put", "puts", "putting",
    "put down", "puts down", "put on", "puts on", "place", "places", "placed", "set down", "sets down", "grab", "grabs", "grabbed",
    "take", "takes", "took", "carry", "carries", "carrying", "lift", "lifts", "open", "opens", "opened", "close", "closes", "closed",
    "use", "uses", "using", "touch", "touches", "reach for", "reaches for", "move", "moves", "drop", "drops", "plug in", "plugs in",
    "unplug", "connect", "connects", "insert", "inserts", "remove", "removes", "wash", "washes", "cut", "cuts", "pour", "pours", "eat",
    "eats", "drink", "drinks", "wear", "wears", "push", "pushes", "pull", "pulls", "hand", "hands", "give", "gives", "bring", "brings",
    "fill", "fills", "press", "presses", "turn on", "turns on", "turn off", "turns off",
)
LETTER_PATTERNS = (
    r"\\boxed\{\(?([A-Za-z])\)?\}",
    r"\*\*\(?([A-Za-z])\)?\*\*",
    r"(?:final answer|correct answer|answer|correct response|option)\s*(?:is|:|=)\s*\**\(?([A-Za-z])\)?\**",
    r"^\(?([A-Za-z])\)?[\.\):]?\s*$",
    r"^\(?([A-Za-z])[\.\)]",
    r"\b([A-Za-z])[\.\)]?\s*$",
)
# Edge punctuation.
_EDGE = r"[\s\"'`.,;:!?()\[\]{}-]+"


def content_id(text: Column, prefix: str = "chunk-") -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_text(text: Column) -> Column:
    """White space as one space, edge punctuation and one leading article away."""
    t = F.regexp_replace(squeeze(text), f"^{_EDGE}|{_EDGE}$", "")
    return F.trim(F.regexp_replace(t, r"(?i)^(the|a|an)\s+", ""))


def one_person(t: Column) -> Column:
    """First-person forms as i, of lower-case normalised text."""
    return F.when(t.isin(*FIRST_PERSON), "i").otherwise(t)


def fold(text: Column) -> Column:
    return one_person(F.lower(normalise_text(text)))


def degenerate(s: Column, p: Column, o: Column) -> Column:
    """Of folded parts: no subject, neither predicate nor object, or an object equal to the subject."""
    return (s == "") | ((p == "") & (o == "")) | ((o != "") & (s == o))


def processed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]", " "))


def surface_form(text: Column, words: int = 4) -> Column:
    """Lower case, no quotes or punctuation, determiners off again and again; null if short, long, a stop form or a fragment."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.trim(text), "^[\"'“”]+|[\"'“”]+$", "")), r"(?U)[^\w\s'-]", " ")
    t = F.regexp_replace(squeeze(t), "^(?:(?:" + "|".join(DETERMINERS) + ") )+", "")
    w = F.split(t, " ")
    return F.when((F.length(t) >= 3) & (F.size(w) <= words) & ~t.isin(*STOP_FORMS) & ~F.get(w, F.lit(0)).isin(*FRAGMENT_OPENERS), t)


def location_labels(text: Column) -> Column:
    """Labels whose keywords stand anywhere in the text, in the vocabulary's order."""
    low = F.lower(text)
    hits = [F.when(F.greatest(*(low.contains(k) for k in ks), F.lit(False)), name) for name, ks in LOCATIONS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def location_cue(text: Column) -> Column:
    labels = location_labels(text)
    return F.when(F.size(labels) == 1, labels[0])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), 0)


def has_phrase(text_tokens: Column, phrase_tokens: Column) -> Column:
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(phrase_tokens) > 0) & pad(text_tokens).contains(pad(phrase_tokens))


def answer_form(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def choice_letter(response: Column, valid: tuple[str, ...] = ("A", "B", "C", "D")) -> Column:
    """First valid letter by the patterns in order; null if none."""
    found = [F.filter(F.transform(F.regexp_extract_all(F.trim(response), F.lit("(?im)" + p), 1), F.upper), lambda x: x.isin(*valid)) for p in LETTER_PATTERNS]
    return F.coalesce(*(F.get(f, F.lit(0)) for f in found))


def first_letter(response: Column) -> Column:
    """Leading letter of a response, bracketed or followed by a mark or not; null if none."""
    return F.nullif(F.upper(F.regexp_extract(F.trim(response), r"^\(?([A-Za-z])[\.\)]?\s*", 1)), F.lit(""))


def bare(text: Column) -> Column:
    """Lower case, trimmed, without full stops, commas and closing brackets at its end."""
    return F.regexp_replace(F.trim(F.lower(text)), r"[.,)]+$", "")


def right_choice(response: Column, gold: Column, gold_text: Column, letter: Column) -> Column:
    """Is it the gold choice: by its text, by the letter found, or by both written out."""
    r = bare(response)
    return F.coalesce((r == bare(gold_text)) | (letter == gold) | (r == bare(F.concat(gold, F.lit(". "), gold_text))) | (r == bare(F.concat(F.lit("("), gold, F.lit(") "), gold_text))), r == bare(gold_text), F.lit(False))


def canonical_key(parts: Column) -> Column:
    """struct(s, p, o) of an array of parts, folded; missing parts are empty."""
    return F.struct(*(fold(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate("spo")))


def strip_option(text: Column) -> Column:
    return F.regexp_replace(text, r"^[A-D][.)]\s*", "")


def manipulated(triple: Column) -> Column:
    """Surface form of what the wearer handles in an array of subject, predicate and object; else null."""
    part = lambda i: F.lower(F.trim(F.get(triple, F.lit(i))))
    return F.when((F.size(triple) == 3) & part(0).isin(*EGO_SUBJECTS) & part(1).isin(*MANIPULATIONS), surface_form(F.get(triple, F.lit(2))))


def valid_triples(triples: Column) -> Column:
    """Rows of exactly three cells, each once, in order."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def aligned(triples: Column, evidence: Column) -> Column:
    """array of struct(triple, evidence) of the valid triples, each with its own evidence."""
    return F.filter(F.arrays_zip(triples.alias("triple"), evidence.alias("evidence")), lambda z: F.size(z["triple"]) == 3)


def speaker_name(person: Column) -> Column:
    """A1_JAKE to Jake."""
    return F.initcap(F.regexp_replace(F.when(person.rlike("^[^_]*_."), F.regexp_replace(person, "^[^_]*_", "")).otherwise(person), "_", " "))


def first_person(text: Column, person: str) -> Column:
    """The wearer's own name as I and my; as a speaker's label it goes."""
    name = (person.partition("_")[2] or person).replace("_", " ")
    quoted = "(?iU)(?<!\\w)\\Q" + name + "\\E"
    t = F.regexp_replace(text, quoted + r":\s*", "")
    return F.regexp_replace(F.regexp_replace(t, quoted + r"'s(?!\w)", "my"), quoted + r"(?!\w)", "I")


def render(texts: Column, person: str) -> Column:
    """Texts in the first person, blank and repeated ones left out, joined by spaces."""
    return F.array_join(F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(first_person(t, person))), lambda t: t != "")), " ")


# Characters that the plain form folds.
SINGLE_QUOTES, DOUBLE_QUOTES, PRIMES = "\u2019\u055a\ua78b\ua78c\uff07\u2018\u201a\u201b`\u00b4\u2032\u2035", "\u201c\u201d\u201e\u201f", {"\u2033": 2, "\u2036": 2, "\u2034": 3, "\u2037": 3, "\u2057": 4}
HYPHENS, SLASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\uff0d\u207b", "\u2044\u2215"


def plain(text: Column) -> Column:
    """Controls out; hyphens, quotes, primes, slashes and the ellipsis in ASCII."""
    t = F.regexp_replace(F.regexp_replace(text, "[\\u000b\\u000c\\u0085]", " "), "[\\u0000-\\u0008\\u000e-\\u001f\\u007f-\\u009f\\u00ad]", "")
    t = F.translate(t, HYPHENS + SINGLE_QUOTES + DOUBLE_QUOTES + SLASHES, "-" * len(HYPHENS) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "/" * len(SLASHES))
    for c, n in PRIMES.items():
        t = F.replace(t, F.lit(c), F.lit("'" * n))
    return F.replace(F.replace(t, F.lit("\u2026"), F.lit("...")), F.lit(" . . . "), F.lit(" ... "))
