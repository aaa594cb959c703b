"""Mapping of typed values to a reference list.

The list's entries and their aliases (folded; houses also without their generic words) are patterns of one Aho-Corasick
automaton. Over a folded value the longest non-overlapping mentions win; a mention is taken if it stands at word borders and
what is left beside it says nothing about identity: words that stand beside many different entries in the data (learned in
a first pass, on top of a few known ones), plain words of running text, or the other half of a label. A word that tells two
entries of the list apart (an edition) is never left aside.

What has no such mention goes to token-set similarity: a weighted soft Jaccard over words, of which each pairs with at most
one of the other set, by edit similarity (one slip: a letter put in, left out, replaced or two swapped) or as an abbreviation
of a generic word; numbers must agree. Candidates come from an index of all one-letter deletions of the words that a set
above the threshold can't do without, so a value is compared with few entries and none above the threshold is missed. The best
score wins if it reaches the threshold; whatever stays is unmatched (0).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redolent.functions.text import fold_text
from redolent.llm.term_frequency import latest
from redolent.session import materialize

#: What people add to a brand.
LEGAL = frozenset("paris parfum parfums perfume perfumes fragrance fragrances official ltd limited inc llc gmbh co company sa sarl srl s a r l london milano and the".split())
#: What people add to a perfume's name, beside a year or a size.
FORM = frozenset("edp edt edc eau de parfum toilette cologne extrait tester spray ml oz fl for men women man woman him her pour homme femme unisex batch reissue refill edition new vintage sample e d p t c the by from of".split())
#: House words that are often left out or shortened, and their short forms.
HOUSE = frozenset("house of maison atelier l officina casa parfums botanica de".split())
SHORT = {"atl": "atelier", "off": "officina", "bot": "botanica", "prfms": "parfums", "prfm": "parfum", "ms": "maison", "mson": "maison", "hse": "house", "and": "", "et": "", "und": "", "y": "", "ve": ""}
_LEET = str.maketrans("30154", "eolsa")
_YEAR = re.compile(r"^(19|20)\d\d$")
_SIZE = re.compile(r"^\d+(ml|oz)$")


def words(value: str, letters_only: bool = False) -> list[str]:
    """Folded words. Digits typed for letters inside a word are read as letters; letters_only: all single digits too."""
    out = []
    for w in (fold_text(value.replace("®", " ").replace("™", " ")) or "").split():
        typed = not w.isdigit() and any(c.isdigit() for c in w) and not _SIZE.match(w) and not re.fullmatch(r"\D+\d{2,}\D*", w)
        if typed or (letters_only and len(w) == 1):
            w = w.translate(_LEET)
        out.append(w)
    return out


def close(a: str, b: str) -> bool:
    """Equal, or one slip apart for words of four letters and more."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or any(c.isdigit() for c in a + b):
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 1 : i + 2] == b[i : i + 1] and b[i + 1 : i + 2] == a[i : i + 1] and a[i + 2 :] == b[i + 2 :])


def deletions(key: str) -> set[str]:
    """The key itself and the key less one letter."""
    return {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))}


def abbreviates(short: str, full: str) -> bool:
    """Two letters or more of a word in order, the first one first, with at most every other one left out or only vowels."""
    if not 2 <= len(short) < len(full) or short[0] != full[0] or not short.isalpha():
        return False
    rest = iter(full)
    if not all(c in rest for c in short):
        return False
    return full.startswith(short) or set("bcdfghjklmnpqrstvwxz") & set(short) <= set(full) and len(short) * 3 >= len(full) and sum(c in "aeiouy" for c in short) < sum(c in "aeiouy" for c in full)


class Matcher:
    """One reference list: entries (id, text), phrases that say nothing beside an entry, and whether it lists houses.

    Of houses, words in several entries are generic (house, maison, ...): they weigh little, may be missing or abbreviated.
    Of names every word counts."""

    #: Least soft Jaccard of a value and the entry it means; least edit similarity of two words.
    THRESHOLD, ALIKE = 0.74, 0.74

    def __init__(self, entries: Iterable[tuple[int, str]], noise: frozenset[str], house: bool, learned: frozenset[str] = frozenset()):
        self.noise, self.house, self.learned = noise, house, learned
        self.entries = {i: words(t) for i, t in entries if i is not None and t}
        self.df = Counter(x for w in self.entries.values() for x in set(w))
        generic = {x for x, n in self.df.items() if n > 2} if house else set()
        self.generic = sorted(generic, key=lambda x: (-self.df[x], x))
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.initials: dict[str, set[int]] = defaultdict(set)
        self.near: dict[str, set[int]] = defaultdict(set)
        self.by_word: dict[str, set[int]] = defaultdict(set)
        alias: dict[str, set[int]] = defaultdict(set)
        for i, w in self.entries.items():
            self.exact[" ".join(w)].add(i)
            for d in deletions("".join(w)):
                self.near[d].add(i)
            for x in set(w):
                for d in deletions(x) if len(x) > 3 and not any(c.isdigit() for c in x) else {x}:
                    self.by_word[d].add(i)
            if house:
                core = [x for x in w if x not in generic and x not in HOUSE]
                if core and len(core) < len(w):
                    alias[" ".join(core)].add(i)
                if len(w) > 2 and all(w):
                    self.initials["".join(x[0] for x in w)].add(i)
        self.alias = {k: v for k, v in alias.items() if len(v) == 1 and k not in self.exact}
        self.editions = self._editions()
        self.trie = ahocorasick.Automaton()
        for k, v in [*self.exact.items(), *self.alias.items()]:
            self.trie.add_word(f" {k} ", (k, frozenset(v)))
        self.trie.make_automaton()

    def _editions(self) -> frozenset[str]:
        """Words by which alone two entries differ: one has it, the other lacks it."""
        if self.house:
            return frozenset()
        return frozenset(w[n] for w in self.entries.values() for n in range(len(w)) if len(w) > 1 and " ".join(w[:n] + w[n + 1 :]) in self.exact)

    def weight(self, word: str) -> float:
        return self.df[word] ** -0.5 if self.house and self.df[word] > 2 else 1.0

    def mentions(self, text: str) -> list[tuple[int, int, frozenset[int]]]:
        """Longest non-overlapping mentions in folded text: (start, end, ids) in order."""
        padded = f" {text} "
        found = sorted(((end - len(k) - 1, end - 1, ids) for end, (k, ids) in self.trie.iter(padded)), key=lambda m: (m[0] - m[1], m[0])) if len(self.trie) else []
        kept: list[tuple[int, int, frozenset[int]]] = []
        for s, e, ids in found:
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, ids))
        return sorted(kept, key=lambda m: m[0])

    @staticmethod
    def around(text: str, s: int, e: int) -> tuple[str, str]:
        """What stands before and after a mention."""
        return text[:s].strip(), text[e:].strip()

    def is_noise(self, w: str) -> bool:
        return w not in self.editions and (w in self.noise or w in self.learned or bool(_YEAR.match(w) or _SIZE.match(w)))

    def says_nothing(self, phrase: str, whole: list[str], plain: frozenset[str] = frozenset()) -> bool:
        """Whether what stands beside a mention tells nothing. plain: words written as running text beside a name."""
        own = phrase.split()
        if not own or (alike_digits(phrase) in self.learned and not self.editions & set(own)):
            return True
        return all(self.is_noise(x) or (x in plain and x not in self.editions) or (x.isdigit() and {"ml", "oz", "pcs"} & set(whole)) for x in own)

    def stripped(self, w: list[str]) -> Iterator[list[str]]:
        """The words, and again and again with one word of noise less at the end (a number before ml is a size)."""
        yield w
        for n in range(len(w) - 1, 0, -1):
            last = w[n]
            if not (self.is_noise(last) or (last.isdigit() and w[n + 1 : n + 2] in (["ml"], ["oz"], ["pcs"]))):
                break
            yield w[:n]

    def spelled_out(self, w: list[str]) -> list[str]:
        """The words of a house with generic words in full where they are abbreviated."""
        if not self.house:
            return w
        full = (SHORT[x] if x in SHORT else x if x in self.df else next((g for g in self.generic if abbreviates(x, g)), x) if len(x) < 5 else x for x in w)
        return [x for x in full if x]

    def mentioned(self, value: str, w: list[str]) -> frozenset[int]:
        """Ids of the one entry mentioned in the value's words, if the rest says nothing."""
        text = " ".join(w)
        inside = self.mentions(text)
        if not inside:
            return frozenset()
        plain = running(value)
        for s, e, ids in sorted(inside, key=lambda m: m[0] - m[1]):
            if len(inside) > 1 and len({i for m in inside for i in m[2]} - ids) and not self.house:
                return frozenset()  # several entries in one value: none is meant more than the other
            if all(self.says_nothing(x, w, plain) for x in self.around(text, s, e)):
                return ids
        return frozenset()

    def find(self, value: str) -> frozenset[int]:
        """Ids of the entries the value may mean: none, one, or several that context must decide between."""
        w = words(value, self.house)
        if not w:
            return frozenset()
        if " ".join(w) in self.exact:
            return frozenset(self.exact[" ".join(w)])
        full = self.spelled_out(w)
        forms = list(self.stripped(full))
        for form in map(" ".join, forms):
            if ids := self.exact.get(form) or self.alias.get(form):
                return frozenset(ids)
        if ids := self.mentioned(value, full):
            return ids
        for form in (w, *forms):
            if ids := self.similar(form):
                return ids
        joined = "".join(w)
        if self.house and 2 < len(joined) < 6 and joined in self.initials and (len(w) == 1 or all(len(x) == 1 for x in w)):
            return frozenset(self.initials[joined])
        return frozenset()

    def _alike(self, a: str, b: str) -> float:
        """Similarity of two words: 1 if equal, less for one slip, 0 if further apart."""
        if a == b:
            return 1.0
        if not close(a, b):
            return 0.0
        return 1 - 1 / max(len(a), len(b))

    def score(self, w: list[str], other: list[str]) -> float:
        """Soft Jaccard of two sets of words by weight; each word pairs once, likelier pairs first."""
        left = list(other)
        shared, slips, total = 0.0, 0, 0.0
        for x in sorted(w, key=lambda x: x not in left):
            best = max(left, key=lambda y: self._alike(x, y), default=None)
            alike = self._alike(x, best) if best is not None else 0.0
            if alike < self.ALIKE or (x.isdigit() and x != best):
                total += self.weight(x)
                continue
            left.remove(best)
            weight = self.weight(best)
            shared, total, slips = shared + weight * alike, total + weight, slips + (alike < 1)
        if any(y.isdigit() for y in left) or any(x.isdigit() and x not in other for x in w):
            return 0.0
        return shared / (total + sum(map(self.weight, left)))

    def similar(self, w: list[str]) -> frozenset[int]:
        """The entries of the best token-set similarity at or above the threshold; joined words count as one word."""
        joined = "".join(w)
        best: dict[int, float] = {}
        if len(joined) >= 4:
            for i in set().union(*(self.near.get(d, ()) for d in deletions(joined))):
                other = "".join(self.entries[i])
                if joined == other:
                    best[i] = 1.0
                elif self.one_slip(joined, other):
                    best[i] = 1 - 1 / max(len(joined), len(other))
        if len(w) > 1 and 1.0 not in best.values():
            # a set above the threshold shares one of the words that together weigh more than what may be missing
            weights = sorted(((self.weight(x), x) for x in w), reverse=True)
            may_miss, keys = (1 - self.THRESHOLD) * sum(a for a, _ in weights), []
            for a, x in weights:
                keys.append(x)
                may_miss -= a
                if may_miss < 0:
                    break
            found = set().union(*(self.by_word.get(d, ()) for x in keys for d in (deletions(x) if len(x) > 3 else {x})))
            for i in found:
                score = self.score(w, self.entries[i])
                if score >= self.THRESHOLD:
                    best[i] = max(best.get(i, 0.0), score)
        if not best:
            return frozenset()
        top = max(best.values())
        return frozenset(i for i, s in best.items() if s >= top - 1e-9)

    @staticmethod
    def one_slip(a: str, b: str) -> bool:
        """close() for joined names that may hold numbers: the slip must not touch a number."""
        return re.sub(r"\D+", " ", a).split() == re.sub(r"\D+", " ", b).split() and close(re.sub(r"\d", "", a), re.sub(r"\d", "", b))


#: Small words that join the parts of a name.
JOINTS = frozenset("by from de of the la le du des di von van et and y e ve und en au d l".split())


def running(value: str) -> frozenset[str]:
    """The folded words of a value that are written small beside words with a capital: running text beside a name. None in a value all small.

    Also words of one letter, and a capitalised first word if a small one that joins no names comes after it."""
    raw = re.findall(r"[^\W_]+", value)
    if not any(w[0].isupper() and w[1:].islower() for w in raw[1:] or raw):
        return frozenset()
    small = [w for w in raw if w.isalpha() and (w.islower() or len(w) == 1)]
    if len(raw) > 1 and raw[0].istitle() and raw[1].islower() and raw[1].isalpha() and raw[1] not in JOINTS:
        small.append(raw[0])
    return frozenset(f for w in small if (f := fold_text(w)))


def alike_digits(phrase: str) -> str:
    return re.sub(r"\d", "0", phrase)


class Catalog:
    """The brands, the names and the labels (name and brand) of the reference lists."""

    def __init__(self, brands: list[tuple[int, str]], labels: list[tuple[int, str, int, str]], learned: dict[str, frozenset[str]] | None = None):
        self.brand_list = {b for _, b in brands}
        self.name_list = {n for _, n, _, _ in labels}
        self.label_list = {x for _, _, _, x in labels}
        self.brand_of = {i: b for i, _, b, _ in labels}
        learned = learned or {}
        self.brands = Matcher(brands, LEGAL, True, learned.get("brand", frozenset()))
        self.names = Matcher([(i, n) for i, n, _, _ in labels], FORM, False, learned.get("name", frozenset()))
        self._brand: dict[str, frozenset[int]] = {}
        self._name: dict[str, frozenset[int]] = {}

    def _memo(self, memo: dict[str, frozenset[int]], find, value: str) -> frozenset[int]:
        if value not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[value] = find(value)
        return memo[value]

    def brand_ids(self, value: str) -> frozenset[int]:
        return self._memo(self._brand, self.brands.find, value)

    def _split(self, value: str) -> Iterator[tuple[str, str]]:
        """Ways to read a value as name and brand, likelier ones first."""
        for sep in (" by ", " from ", " - ", ": "):
            at = value.casefold().rfind(sep)
            if at > 0:
                a, b = value[:at], value[at + len(sep) :]
                yield from ((a, b), (b, a)) if sep in (" - ", ": ") else ((a, b),)
        if m := re.fullmatch(r"(.+?)\s*\(([^()]+)\)\s*", value):
            yield m[1], m[2]

    def _name_ids(self, value: str) -> frozenset[int]:
        if ids := self.names.find(value):
            return ids
        for name, brand in self._split(value):
            ids = self.names.find(name)
            if ids:
                own = self.brand_ids(brand)
                fit = frozenset(i for i in ids if self.brand_of[i] in own)
                return fit or (ids if len(ids) == 1 and not own else frozenset())
        text, plain = " ".join(words(value)), running(value)
        for s, e, brand in self.brands.mentions(text):  # brand and name without a mark between them
            rest = " ".join(x for x in self.brands.around(text, s, e) if x)
            fit = frozenset(i for i in (self.names.find(rest) if rest else ()) if self.brand_of[i] in brand)
            if fit:
                return fit
            for a, z, ids in self.names.mentions(rest):  # both in running text
                if (fit := frozenset(i for i in ids if self.brand_of[i] in brand)) and all(self.names.says_nothing(x, rest.split(), plain) for x in self.names.around(rest, a, z)):
                    return fit
        return frozenset()

    def name_ids(self, value: str) -> frozenset[int]:
        return self._memo(self._name, self._name_ids, value)

    def resolve(self, brand: str | None, name: str | None) -> tuple[int, int]:
        """(brand_id, label_id) of one perfume row, 0 where the list has none; each half decides between readings of the other."""
        b = self.brand_ids(brand) if brand else frozenset()
        n = self.name_ids(name) if name else frozenset()
        if len(n) > 1:
            n = frozenset(i for i in n if self.brand_of[i] in b) if b else n
        if len(b) > 1:
            b = b & {self.brand_of[i] for i in n} if n else b
        return (min(b) if len(b) == 1 else 0), (min(n) if n else 0)


#: Most entries of a list that is sent to every worker (some 100 bytes each, and their indexes about 2 KB).
ENTRIES = 200_000


def load(brands: DataFrame, labels: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The rows of the fixed lists. They don't grow with the data; a list of more than ENTRIES is refused, as it would be no list to broadcast."""
    out = []
    for own in (brands.select("brand_id", "brand").dropna(), labels.select("label_id", "name", "brand_id", "label").dropna()):
        rows = own.limit(ENTRIES + 1).collect()
        if len(rows) > ENTRIES:
            raise ValueError(f"a reference list of more than {ENTRIES} entries: map it in parts")
        out.append([tuple(r) for r in rows])
    return out[0], out[1]


_CATALOGS: dict[int, tuple[object, Catalog]] = {}


def _catalog(shared) -> Catalog:
    """The catalog of a broadcast, built once for each worker process."""
    lists = shared.value
    if id(lists) not in _CATALOGS:
        _CATALOGS.clear()
        _CATALOGS[id(lists)] = (lists, Catalog(*lists))
    return _CATALOGS[id(lists)][1]


def learn_noise(rows: DataFrame, shared, least: int = 3, share: float = 1 / 2_000) -> dict[str, frozenset[str]]:
    """Phrases and words that say nothing about identity, by field: those that stand beside mentions of at least `least` different
    entries (digits made alike), and in at least a share of the values with one mention and something beside it, so there are at
    most 2 / share words and phrases a field, whatever the data. A phrase needs a word that no entry has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog = _catalog(shared)
        for batch in batches:
            out: set[tuple[str, str, int]] = set()
            for brand, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for field, value, matcher in (("brand", brand, catalog.brands), ("name", name, catalog.names)):
                    w = words(value, matcher.house) if value else []
                    text = " ".join(w)
                    if not w or text in matcher.exact or len(found := matcher.mentions(text)) != 1:
                        continue
                    s, e, ids = found[0]
                    for phrase in matcher.around(text, s, e):
                        own = phrase.split()
                        if own and not matcher.editions & set(own) and any(x not in matcher.df for x in own):
                            out |= {(field, alike_digits(phrase), i) for i in ids}
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["field", "phrase", "entry"])

    seen = rows.mapInArrow(run, "field string, phrase string, entry long")
    by = materialize(seen.groupBy("field", "phrase").agg(F.count_distinct("entry").alias("entries"), F.count("*").alias("n")), "noise")
    total = {r.field: r.n for r in by.groupBy("field").agg(F.sum("n").alias("n")).collect()}
    out: dict[str, set[str]] = defaultdict(set)
    for field, n in total.items():
        for r in by.where((F.col("field") == field) & (F.col("entries") >= least) & (F.col("n") >= share * n)).collect():
            out[field].add(r.phrase)
    return {k: frozenset(v) for k, v in out.items()}


def map_values(perfumes: DataFrame, cases: DataFrame, brands: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, record_key, ref_id) for every typed brand, name and reference that isn't, letter for letter, an entry.

    Null and blank values have no row; a value without an entry has ref_id 0. Repeated rows of a perfume or case count once
    (perfumes: the latest); null keys are no records. Empty lists leave everything unmatched. The lists are small fixed
    tables, their size is checked, and they go to the workers whole; the data stay where they are but for taking repeated
    rows together.
    """
    sc = perfumes.sparkSession.sparkContext
    own = latest(perfumes, "perfume_id", ["brand", "name"], "ingested_at").select(F.lit("perfume").alias("kind"), F.col("perfume_id").cast("string").alias("key"), "brand", "name")
    typed = cases.where("id IS NOT NULL").groupBy("id").agg(F.max("expected_resolved_reference").alias("name")).select(F.lit("case"), F.col("id").cast("string"), F.lit(None).cast("string"), "name")
    rows = materialize(own.union(typed), "typed")
    entries = load(brands, labels)
    lists = sc.broadcast((*entries, learn_noise(rows, sc.broadcast((*entries, None)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalog = _catalog(lists)
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for kind, key, brand, name in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == "case":
                    if name and name.strip() and name not in catalog.label_list:
                        out.append(("reference", key, min(catalog.name_ids(name), default=0)))
                    continue
                b, n = catalog.resolve(brand, name)
                if brand and brand.strip() and brand not in catalog.brand_list:
                    out.append(("brand", key, b))
                if name and name.strip() and name not in catalog.name_list:
                    out.append(("name", key, n))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["field", "record_key", "ref_id"])

    return rows.mapInArrow(run, "field string, record_key string, ref_id long")
