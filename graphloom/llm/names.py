"""Variant spellings of names typed by people.

Method: every name is rewritten into all its canonical forms by rules for
nicknames, initials, short forms, legal forms, abbreviations, token order,
titles and mistyping. The forms are exploded and equi-joined, and a shared form
counts by its rarity, 1 / (number of identities that share it): only forms of
score 1 link. Of two words that a mistyped letter would explain, one must be
rare: borne by one name only, or by at most ``FEW`` and a quarter as many as
bear the other, or by a twentieth of these. So two given names that are both in
use, or both on the list of known given names, stay two persons however alike
they are.

Linking runs in three layers. Whole names are joined into identities
(connected components of the keys that share a checked form); abbreviated
organisations, nicknames, cut-off and middle names follow where they mean one
identity only. Names with an initial or an acronym, then single words, are
attached to the one identity that their form leads to. The cleaned name of an
entity, where given, is one more name of it.

Every id with a name gets an identity:

* words are runs of letters and digits of any script, names may have any number
  of words; joining particles and titles of persons and legal forms of
  organisations do not count;
* a name that fits several identities is not linked to any; its identity is
  its own reading, with the score 1 / their number;
* names of neither persons nor organisations (a number without a sign of an
  organisation, or a word that mostly stands in entities of other types) are of
  kind ``x`` and equal only to names of the same words; those with a number are
  organisations if their type says so and no word speaks against it;
* null and blank names are ignored, null ids too; a name of several ids links
  them; repeated rows and further columns change nothing.

A form of one mistyped word is shared by at most as many spellings as there are
words one or two letters longer, whatever the size of the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import stage, unstage

# What stands before or after a person's name, and joining particles inside it.
TITLES = set("dr prof professor mr mrs ms miss eng ing sir dame rev hon phd msc bsc ba ma mba md esq jr sr dphil".split())
PARTICLES = set("de del della der den di da dos van von zu zur la le el al bin ibn ter ten af av y e".split())
# Legal forms of organisations and joining words, neither of which distinguish them.
LEGAL = set("ltd limited llc lc gmbh mbh gesellschaft inc incorporated corp corporation sa ag plc co company the of for and und".split())
LEGAL_SIGN = LEGAL - set("the of for and und ma co".split())
# Words for kinds of organisations, with their usual abbreviations.
KINDS = set("museum university college academy laboratory department bureau society foundation centre center institute school association council".split())
ABBREVIATED = {"ctr": "centre", "cntr": "centre", "center": "centre", "dept": "department", "fdn": "foundation", "fndn": "foundation", "univ": "university", "lab": "laboratory", "soc": "society", "mus": "museum", "coll": "college", "acad": "academy", "bur": "bureau", "inst": "institute", "assn": "association"}
BARE_ABBREVIATIONS = ("lab", "ctr", "dept", "fdn")
# Letters that look like others when scanned or typed.
LOOKALIKE = (("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"))
LONG_WORD = 7
FEW = 3

_WORD = re.compile(r"[^\W_]+")


def fold(s: str) -> str:
    """Lower case without accents; every white space a blank."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.casefold().replace("’", "'").split())


def unscan(w: str) -> str:
    """Digits typed or scanned for letters inside a word."""
    return w.translate(str.maketrans("01358", "olesb")) if len(re.findall("[a-z]", w)) > 2 else w


def lookalike(w: str) -> str:
    for a, b in LOOKALIKE:
        w = w.replace(a, b)
    return w


def distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, at most ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def alike(a: str, b: str) -> bool:
    """Equal but for one mistyped letter (two in long words), letters in another order, or look-alikes."""
    if a == b or lookalike(a) == lookalike(b):
        return True
    if min(len(a), len(b)) < 4 or a.isdigit() or b.isdigit():
        return False
    if min(len(a), len(b)) >= LONG_WORD:
        return distance(a, b, 2) <= 2
    return distance(a, b, 1) <= 1 or sorted(a) == sorted(b) and distance(a, b, 2) <= 2


def drops(w: str) -> set[str]:
    """The word, and without any one letter (any two of a long one): words so many letters apart share one of these."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(w) >= LONG_WORD:
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out | {w}


class Reading:
    """One name taken apart: kind, layer and key.

    kind p (person), o (organisation) or x (neither); layer 0: whole name; 1: an
    initial and a word, or a lead and an acronym; 2: one word; -1: kind x.
    Keys: ``p|words``, ``o|lead|content``, ``i|initial|word``, ``a|lead|initials``,
    ``w|word``, ``x|words``. A content word cut off by a full stop keeps it.
    """

    __slots__ = ("key", "kind", "layer")

    def __init__(self, name: str):
        text = fold(name)
        # "s.a.", "l.l.c." and the like are one word each.
        text = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m[0].replace(".", "") + " ", text)
        text = re.sub(r"(?<=[^\W_])-(?=[^\W_])", "", text)
        raw = [unscan(w) for w in _WORD.findall(text.replace("'", ""))]
        cut_off = {w for w in re.findall(r"([^\W\d_]{2,})\.(?=\s|$|,)", text)} - TITLES - LEGAL
        kinds = [w for w in raw if w in KINDS or w in ABBREVIATED and (w in cut_off or w in BARE_ABBREVIATIONS)]
        org = bool("&" in text or kinds or any(w in LEGAL_SIGN for w in raw[1:]) or len(raw) > 2 and "and" in raw[1:-1] or len(raw) > 2 and any(len(w) > 2 for w in cut_off))
        if org and any(w not in LEGAL for w in raw):
            self._organisation(text, [w + "." if w in cut_off and w not in ABBREVIATED else ABBREVIATED.get(w, w) for w in raw if w not in LEGAL])
        elif any(w.isdigit() for w in raw) or not any(w not in TITLES and w != "the" for w in raw):
            self.kind, self.layer, self.key = "x", -1, "x|" + (" ".join(raw) or text)
        else:
            self._person(name, [w for w in raw if w not in TITLES and w != "the"])

    def _organisation(self, text: str, words: list[str]) -> None:
        if "," in text and len(words) > 1 and (words[0] in KINDS or words[0].endswith(".") and any(k.startswith(words[0][:-1]) for k in KINDS)):
            words = [words[-1], *words[:-1]]  # "University of Zoology, Lead"
        self.kind, lead = "o", words[0].rstrip(".")
        self.layer = 0 if words[1:] else 2
        self.key = f"o|{lead}|{','.join(sorted(words[1:]))}" if words[1:] else f"w|{lead}"

    def _person(self, name: str, words: list[str]) -> None:
        # A single character of a script without cases is a word, not an initial.
        long = [w for w in words if len(w) > 1 or w.upper() == w]
        initials = [w for w in words if len(w) == 1 and w.upper() != w]
        self.kind = "p"
        if len(long) == 2 and self._acronym(name, long):
            self.kind, self.layer, self.key = "o", 1, f"a|{long[0]}|{long[1]}"
        elif len(long) > 1:
            self.layer = 0
            core = [w for w in long if w not in PARTICLES]
            self.key = "p|" + "|".join(sorted(core if len(core) > 1 else long))
        elif long and initials:
            self.layer, self.key = 1, f"i|{initials[0]}|{long[0]}"
        elif long:
            self.layer, self.key = 2, f"w|{long[0]}"
        elif len(initials) > 1:
            self.layer, self.key = 0, "p|" + "|".join(sorted(initials))
        else:
            self.layer, self.key = 2, f"w|{initials[0]}"

    @staticmethod
    def _acronym(name: str, long: list[str]) -> bool:
        """Whether "Lead MZ" may be meant: two letters or so, in capitals or in a name of one case."""
        short = long[1]
        if not short.isalpha() or not (len(short) == 2 or len(short) in (3, 4) and not re.search("[aeiouy]", short)):
            return False
        typed = [w for w in _WORD.findall(name) if fold(w) == short]
        return bool(typed) and (typed[-1].isupper() if name != name.lower() else True)


def parts(key: str) -> tuple[str, list[str]]:
    """Kind and words of a whole name's key: the lead first if it is an organisation."""
    kind, *words = key.split("|")
    return kind, [words[0], *words[1].split(",")] if kind == "o" else words


def borne_words(key: str) -> set[tuple[str, str]]:
    """(word, who bears it): the words of a whole name with the rest of it, content words cut to three letters."""
    kind, words = parts(key)
    cut = words if kind == "p" else [words[0], *(w[:3] for w in words[1:])]
    return {(w, "|".join(sorted(cut[:i] + cut[i + 1 :]))) for i, w in enumerate(words)}


def _initials(content: list[str]) -> str:
    return "".join(sorted(w[0] for w in content))


def strong_forms(key: str) -> set[str]:
    """Forms of a whole name that a mistyped or abbreviated spelling of it shares."""
    kind, words = parts(key)
    if kind == "p":
        out = {key}
        for i, w in enumerate(words):
            if len(w) >= 4 and not w.isdigit():
                rest = "|".join(words[:i] + words[i + 1 :])
                out |= {f"d|{rest}|{d}" for d in drops(w)} | {f"s|{rest}|{''.join(sorted(w))}", f"l|{rest}|{lookalike(w)}"}
        return out
    # Content words are cut to three letters in the forms only; the pair is checked by full words.
    lead, stems = words[0], sorted(w[:3] for w in words[1:])
    content = ",".join(stems)
    out = {f"do|{content}|{lead}", f"lo|{content}|{lookalike(lead)}"}
    if len(lead) >= 4:
        out |= {f"do|{content}|{d}" for d in drops(lead)} | {f"so|{content}|{''.join(sorted(lead))}"}
    for i, w in enumerate(words[1:], 1):
        if len(w) >= 5 and not w.endswith("."):
            rest = ",".join(sorted(x[:3] for j, x in enumerate(words[1:], 1) if j != i))
            out |= {f"dc|{lead}|{rest}|{w[:j] + w[j + 1 :]}" for j in range(len(w))} | {f"dc|{lead}|{rest}|{w}"}
    return out


def short_forms(key: str, nicknames: dict[str, set[str]]) -> set[str]:
    """What a whole person's name may be meant as, its nickname or cut-off name written out."""
    kind, words = parts(key)
    out = set()
    if kind == "p" and len(words) == 2:
        out.add("m|" + "|".join(words))
        for w, rest in (words, words[::-1]):
            out |= {"p|" + "|".join(sorted((full, rest))) for full in nicknames.get(w, ())}
            if len(w) <= 4:
                out.add(f"b|{w}|{rest}")
    return out


def long_forms(key: str) -> set[str]:
    """The short forms that may mean this whole name."""
    kind, words = parts(key)
    if kind != "p":
        return set()
    out = {key}
    if len(words) == 2:
        for w, rest in (words, words[::-1]):
            out |= {f"b|{w[:n]}|{rest}" for n in (3, 4) if len(w) > n}
    else:  # without its middle names, whichever these are
        out |= {"m|" + "|".join(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :]}
    return out


def weak_forms(key: str) -> set[str]:
    """The partial names that may mean this name (whole, or an initial and a word)."""
    kind, *rest = key.split("|")
    if kind == "i":
        return {f"w|{rest[1]}"}
    if kind == "w":
        return {key}
    kind, words = parts(key)
    if kind == "p":
        return {f"w|{w}" for w in words} | {f"i|{w[0]}|{x}" for i, w in enumerate(words) for j, x in enumerate(words) if i != j}
    return {f"w|{words[0]}", f"a|{words[0]}|{_initials(words[1:])}"}


def tried_forms(key: str) -> set[str]:
    """The forms under which a partial name is looked up."""
    kind, *rest = key.split("|")
    if kind == "a":
        return {f"a|{rest[0]}|{_initials(list(rest[1]))}"}
    joined = kind == "w" and len(rest[0]) > 5  # an initial written together with the surname
    return {key, f"i|{rest[0][0]}|{rest[0][1:]}"} if joined else {key}


def mistyped(w: str) -> set[str]:
    """Every word one mistyped letter away, none for short words."""
    if len(w) < 6:
        return set()
    letters = "abcdefghijklmnopqrstuvwxyz" if w.isascii() else "".join(sorted(set(w)))
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {w}


def mistyped_keys(key: str) -> set[str]:
    """The partial names that a partial name may be a mistyped form of."""
    kind, *rest = key.split("|")
    at = 1 if kind == "i" else 0
    if kind == "a":
        rest[1] = _initials(list(rest[1]))
    return {"|".join([kind, *rest[:at], w, *rest[at + 1 :]]) for w in mistyped(rest[at])}


def compare(a: str, b: str) -> tuple[str, str | None, str | None] | None:
    """How two whole names that share a form are related: (how, word, word), or None if they are not.

    how is ``same`` (equal but for one mistyped word, which is named), ``abbr``
    (a abbreviates b), ``rbba`` (b abbreviates a) or ``both`` (two abbreviations that agree).
    """
    kind, left = parts(a)
    other, right = parts(b)
    if kind != other or len(left) != len(right):
        return None
    if kind == "p":
        x, y = list(left), list(right)
        for w in left:
            if w in y:
                x.remove(w)
                y.remove(w)
        return ("same", x[0], y[0]) if len(x) == 1 and alike(x[0], y[0]) else None
    differing = [] if left[0] == right[0] else [(left[0], right[0])]
    x, y = left[1:], right[1:]
    for w in left[1:]:
        if w in y:
            x.remove(w)
            y.remove(w)
    cut_a = cut_b = False
    for w in list(x):
        for v in y:
            short_a, short_b = w.endswith(".") and v.startswith(w[:-1]), v.endswith(".") and w.startswith(v[:-1])
            if short_a or short_b:
                cut_a, cut_b = cut_a or short_a, cut_b or short_b
                x.remove(w)
                y.remove(v)
                break
    if len(x) == 1 and not differing and min(len(x[0]), len(y[0])) >= 5 and not (x[0] + y[0]).count(".") and distance(x[0], y[0], 1) <= 1:
        differing, x = [(x[0], y[0])], []
    if x or differing and not alike(*differing[0]):
        return None
    still_cut = any(w.endswith(".") for w in left[1:]), any(w.endswith(".") for w in right[1:])
    how = "both" if all(still_cut) else "abbr" if cut_a or still_cut[0] else "rbba" if cut_b or still_cut[1] else "same"
    return how, *(differing[0] if differing else (None, None))


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    """Runs ``make(*row) -> iterable of tuples`` over the rows."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t for row in zip(*(c.to_pylist() for c in b.columns)) for t in make(*row)]
            cols = list(zip(*out)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def _hashed(forms: set[str]) -> set[int]:
    """64-bit hashes of forms; what they join is checked or counted by full words."""
    return {xxhash.xxh64_intdigest(f) - (1 << 63) for f in forms}


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever the planner takes for the size of a side.

    It would take the size of compressed files for that of their rows, and forms
    for as few as the names they are made of, and send what it thinks small
    through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{3,})"), 1))


def other_words(entities: DataFrame, name: str, kind: str, most: float = 3.0, least: int = 3) -> DataFrame:
    """(word): words that stand mostly in entities of types other than person and organisation."""
    ours = F.lower(F.coalesce(F.col(kind), F.lit(""))).rlike("^(person|org)")
    rows = entities.where(F.col(kind).isNotNull()).select(ours.cast("int").alias("ours"), F.explode(_words(F.col(name))).alias("word"))
    counts = rows.groupBy("word").agg(F.sum("ours").alias("ours"), F.count("*").alias("n"))
    return counts.where((F.col("n") - F.col("ours") >= least) & (F.col("n") - F.col("ours") > most * F.col("ours"))).select("word")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label): connected components of (a, b), by spreading and jumping to the least label."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(rounds):
        labels_now = labels.select("node", "label")
        spread = _join(both, labels_now.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = spread.unionByName(labels_now).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels_now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        old = labels_now.withColumnRenamed("label", "old")
        step = _join(least, jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), "label").alias("label"))
        moved = stage(_join(step, old, "node").select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
        unstage(labels)
        labels = moved
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _leads(forms: DataFrame) -> DataFrame:
    """(form, to, n): the identity that a form leads to and how many share the form; its score is 1 / n."""
    return forms.select("form", "to").distinct().groupBy("form").agg(F.min("to").alias("to"), F.count("*").alias("n"))


def _fit(tried: DataFrame, leads: DataFrame) -> DataFrame:
    """(id, key, to, n) of (id, key, form): the identity all forms of an id lead to; n is null if there is none."""
    fitting = _join(tried, leads, "form", "left").groupBy("id", "key").agg(F.min("to").alias("to"), F.max("to").alias("_to"), F.max("n").alias("n"))
    return fitting.select("id", "key", "to", F.when(F.col("to") < F.col("_to"), F.greatest("n", F.lit(2))).otherwise(F.col("n")).alias("n"))


def _rare(n: Column, other: Column) -> Column:
    """Whether a word with n bearers may be a mistyped one with ``other`` bearers."""
    return n <= F.when(n <= FEW, F.greatest(F.lit(1), other / 4)).otherwise(other / 20)


def _mistypings(same: DataFrame, typo) -> DataFrame:
    """(a, b): each mistyped spelling with the name it is meant for.

    That is the nearest one with more bearers; where two such names are equally
    near, neither is taken. Spellings without such a name are linked as they are.
    """
    way = lambda a, b, u, v: same.where(typo(u, v)).select(F.col(a).alias("r"), F.col(b).alias("p"), F.col(f"n_{u}").alias("n_r"), F.col(f"n_{v}").alias("n_p"), "far")
    directed = way("a", "b", "u", "v").unionByName(way("b", "a", "v", "u"))
    # As many as there are spellings one or two letters from r.
    near = directed.where("n_p > n_r").groupBy("r").agg(F.min(F.struct("far", -F.col("n_p"), "p")).alias("best"), F.collect_list(F.struct("far", "n_p")).alias("all"))
    n = -F.col("best.col2")
    rival = lambda x: (x.far == F.col("best.far")) & ~_rare(x.n_p, n)
    near = stage(near.select("r", F.col("best.p").alias("p"), (F.size(F.filter("all", rival)) == 1).alias("clear")))
    level = directed.where("n_p = n_r").select(F.least("r", "p").alias("r"), F.greatest("r", "p").alias("p")).distinct()
    for c in ("r", "p"):
        level = _join(level, near.select(F.col("r").alias(c)), c, "left_anti")
    return near.where("clear").select(F.col("r").alias("a"), F.col("p").alias("b")).unionByName(level.select(F.col("r").alias("a"), F.col("p").alias("b")))


def identities(entities: DataFrame, nicknames: DataFrame, entity_id: str = "entity_id", name: str = "name", clean: str = "canonical_name", kind: str = "entity_type", nick: str = "nickname", given: str = "given_name") -> DataFrame:
    """(id, identity, kind, score) of every entity with a name; score 1 links the ids of one identity.

    The nickname list is a fixed table of known short names; it is read once and
    its size is checked.
    """
    spark = entities.sparkSession
    listed = nicknames.select(nick, given).where(F.col(nick).isNotNull() & F.col(given).isNotNull()).distinct().take(200_001)
    if len(listed) > 200_000:
        raise ValueError("the nickname list is too long to be held by every worker")
    known: dict[str, set[str]] = {}
    for r in listed:
        known.setdefault(fold(r[0]), set()).add(fold(r[1]))
    held = spark.sparkContext.broadcast((known, set(known).union(*known.values())))

    rows = entities.select(F.col(entity_id).cast("string").alias("id"), F.col(name).alias("name"), F.col(clean).alias("clean"), F.col(kind).alias("kind")).where("id is not null")
    says_org = F.coalesce(F.lower("kind").startswith("org"), F.lit(False))
    typed = rows.select("id", F.explode(F.array("name", "clean")).alias("name"), says_org.alias("says_org")).where("trim(name) <> ''")

    def read(n: str, org: bool):
        r = Reading(n)
        yield n, r.key, "o" if r.kind == "x" and org else r.kind, r.layer

    parsed = stage(_rows(typed.groupBy("name").agg(F.max("says_org")), read, "name string, key string, kind string, layer int"))
    # Names of other things: they look like people ("Lake X", "X cluster") or have a number.
    worded = parsed.where("kind = 'p' or layer = -1").select("name", F.explode(_words(F.col("name"))).alias("word"))
    foreign = _join(worded, other_words(rows, "name", "kind"), "word", "left_semi").select("name", F.lit(True).alias("foreign")).distinct()
    sorted_out = _join(parsed, foreign, "name", "left").select(
        "name", F.when(F.col("foreign") & (F.col("layer") >= 0), F.concat(F.lit("x|"), "key")).otherwise(F.col("key")).alias("key"),
        F.when(F.col("foreign"), "x").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("foreign"), -1).otherwise(F.col("layer")).alias("layer"))
    links = stage(_join(typed.select("id", "name"), sorted_out, "name").select("id", "key", "kind", "layer").distinct())

    # Layer 0: strong forms, checked pairwise by full words and by the rarity of the word that differs.
    whole = stage(links.where("layer = 0").select("key").distinct())
    forms = _rows(whole, lambda k: ((k, f) for f in _hashed(strong_forms(k))), "key string, form long")
    pairs = _join(forms.withColumnRenamed("key", "a"), forms.withColumnRenamed("key", "b"), "form").where("a < b").select("a", "b").distinct()

    def check(a: str, b: str):
        if found := compare(a, b):
            how, u, v = found
            lead = "o:" if a.startswith("o|") else "p:"
            fixed = lead == "p:" and u in held.value[1], lead == "p:" and v in held.value[1]
            if not all(fixed):
                far = 0 if u is None else 1 if lookalike(u) == lookalike(v) else distance(u, v)
                yield (b, a, "abbr") if how == "rbba" else (a, b, how), u and lead + u, v and lead + v, *fixed, far

    checked = _rows(pairs, lambda a, b: ((*p, *rest) for p, *rest in check(a, b)), "a string, b string, how string, u string, v string, fixed_u boolean, fixed_v boolean, far int")
    bearers = _rows(whole, lambda k: ((f"{k[0]}:{w}", rest) for w, rest in borne_words(k)), "word string, bearer string").distinct().groupBy("word").agg(F.count("*").alias("n"))
    u, v = (bearers.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in "uv")
    typo = lambda x, y: ~F.col(f"fixed_{x}") & _rare(F.col(f"n_{x}"), F.col(f"n_{y}"))
    related = stage(_join(_join(checked, u, "u", "left"), v, "v", "left").where(F.col("u").isNull() | typo("u", "v") | typo("v", "u")))
    joined = _mistypings(related.where("how = 'same' and u is not null"), typo).unionByName(related.where("how = 'same' and u is null").select("a", "b"))
    # An entity's two names are one identity.
    own = links.where("layer = 0").groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).where("n > 1")
    more = _join(links.where("layer = 0"), own.where("n > 2").select("id", "a"), "id").select("a", F.col("key").alias("b"))
    labels = components(joined.unionByName(own.select("a", "b")).unionByName(more).where("a <> b"))
    named = stage(_join(whole, labels.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("label", "key").alias("label")))

    # Abbreviations, short given names and left-out middle names lead to the one identity they can mean.
    short = _rows(named, lambda k, label: ((label, f) for f in _hashed(short_forms(k, held.value[0]))), "label string, form long")
    full = _rows(named, lambda k, label: ((label, f) for f in _hashed(long_forms(k))), "to string, form long")
    from_short = _join(short, full, "form").select("label", "to")
    label = lambda c, to: named.select(F.col("key").alias(c), F.col("label").alias(to))
    from_cut = _join(_join(related.where("how = 'abbr'"), label("a", "label"), "a"), label("b", "to"), "b").select("label", "to")
    meant = from_short.unionByName(from_cut).where("label <> to").distinct().groupBy("label").agg(F.min("to").alias("to"), F.count("*").alias("n"))
    meant = stage(meant)
    agreeing = _join(_join(related.where("how = 'both'"), label("a", "x"), "a"), label("b", "y"), "b").select("x", "y").distinct()
    lost = meant.select("label")
    for c in ("x", "y"):
        agreeing = _join(agreeing, lost.withColumnRenamed("label", c), c, "left_anti")
    labels = components(meant.where("n = 1").select(F.col("label").alias("a"), F.col("to").alias("b")).unionByName(agreeing.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    placed = _join(named, labels.select(F.col("node").alias("label"), F.col("label").alias("identity")), "label", "left")
    identity = stage(placed.select("key", F.coalesce("identity", "label").alias("identity")))

    # Entities with a whole name; then initials and acronyms; then single words.
    done = _join(links.where("layer = 0"), identity, "key").groupBy("id").agg(F.min("identity").alias("identity"), F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    letters = F.split("key", "\\|")
    own = F.concat(F.lit("p|"), F.array_join(F.array_sort(F.slice(letters, 2, 2)), "|"))  # "Bo LI", an acronym of no organisation, is a person
    spoken = _rows(identity, lambda k, to: ((to, f) for f in _hashed(weak_forms(k))), "to string, form long")
    for layer in (1, 2):
        open_ids = _join(links.where(F.col("layer") == layer), done, "id", "left_anti")
        kinds = open_ids.groupBy("id").agg(F.min("kind").alias("kind"))
        leads = _leads(spoken)
        fitted = stage(_fit(_rows(open_ids.select("id", "key"), lambda i, k: ((i, k, f) for f in _hashed(tried_forms(k))), "id string, key string, form long"), leads))
        # Those that fit nothing may be mistyped; they are few, so they are varied, not what they are compared with.
        unfit = fitted.groupBy("id").agg(F.max("n").alias("n")).where("n is null").select("id")
        varied = _rows(_join(fitted, unfit, "id").select("id", "key"), lambda i, k: ((i, k, f) for f in _hashed(mistyped_keys(k) | {k})), "id string, key string, form long")
        best = fitted.where("n is not null").unionByName(_fit(varied, leads))
        best = best.groupBy("id").agg(F.min("key").alias("key"), F.min("to").alias("to"), F.max("to").alias("_to"), F.max("n").alias("n"))
        n = F.when(F.col("to") < F.col("_to"), F.greatest("n", F.lit(2))).otherwise(F.coalesce("n", F.lit(1)))
        # Forms that lead nowhere are identities of their own, shared by the entities that have them.
        ends = F.when(F.col("key").startswith("a|"), own).otherwise(F.col("key"))
        new = stage(_join(best, kinds, "id").select("id", F.when(n == 1, F.coalesce("to", ends)).otherwise(F.col("key")).alias("identity"), "kind", (1 / n).alias("score"), F.col("to").isNull().alias("alone")))
        if layer == 1:
            alone = new.where("alone").select("identity").distinct()
            spoken = spoken.unionByName(_rows(alone, lambda k: ((k, f) for f in _hashed(weak_forms(k))), "to string, form long"))
        new = new.drop("alone")
        done = stage(done.unionByName(new))
    rest = _join(links.where("layer = -1"), done, "id", "left_anti").groupBy("id").agg(F.min("key").alias("identity"), F.min("kind").alias("kind"))
    return done.unionByName(rest.withColumn("score", F.lit(1.0)))


def name_pairs(placed: DataFrame) -> DataFrame:
    """(entity_a, entity_b): pairs of ids of one person or organisation."""
    sure = placed.where((F.col("kind") != "x") & (F.col("score") == 1))
    a, b = sure.select("identity", F.col("id").alias("entity_a")), sure.select("identity", F.col("id").alias("entity_b"))
    return _join(a, b, "identity").where("entity_a < entity_b").select("entity_a", "entity_b").distinct()
