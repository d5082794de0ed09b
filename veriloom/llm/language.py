"""Language of texts and of the segments of mixed texts, by code length (problem 1).

A text is cut into sentences; each sentence gets its code length under every language's frozen context tree
(see ppm.py) and belongs to the language with the shortest one. Neighbouring sentences of one language are a
segment. Sentences that are only names, headings or placeholders have no language: they join no segment. The
mark of a list item is left out and the rest judged: a whole sentence has a language, a few words (a name, an
option) have none. Neither has a sentence in no known language: one whose letters are mostly of other scripts, or
that the best tree codes worse than no tree at all would (NO_MODEL_BITS a byte). The confidence of a segment is the share of
its language's probability, with the code lengths taken per LETTERS_PER_FACT letters, since neighbouring bytes
are not independent evidence.

The trees are learned from a bounded sample of labelled rows (SAMPLE_ROWS whole rows a language, those with the
smallest hash of their key) and a few sentences of general text that are part of this module, so that a language
is known even where no row is labelled with it. Other languages, named by a two-letter code in LEAST_LABELLED
rows of the sample or more, get a tree of their own. Labels may be wrong: sentences whose words fit another
language better are left out before the training.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm.ppm import Ppm

SAMPLE_ROWS = 200  # labelled rows a language for training
LEAST_LABELLED = 50  # rows of the sample that name a language not listed below, for it to be one
NO_MODEL_BITS = 8.0  # bits a byte of a text in a script of the trees, without any knowledge
OTHER_SCRIPT = 0.3  # share of letters of other scripts that makes a sentence one of no known language
ITEM_WORDS, ITEM_HAN = 6, 12  # words (Chinese characters) of a list item without a sentence end that make it a sentence
ITEM_ENDED_WORDS, ITEM_ENDED_HAN = 3, 6  # and of one with a sentence end
MARGIN_BITS = 16.0  # a sentence has a language if the second best is so much longer
LETTERS_PER_FACT = 40.0
CHUNK = 1_500_000  # bytes scored at once
SIFT_ROUNDS = 3
USUAL_SHARE = 0.004  # a word counts in the sifting if so many sentences of some language hold it

# Usual codes and names of the languages.
NAMES = {
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "ingles", "英语", "英文"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "chinois", "chino", "中文", "汉语", "华语"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "德语", "德文"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "法语", "法文"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "西班牙语", "西班牙文"],
}

# General text in each language.
GENERAL = {
    "en": "This is a short text about the weather and the town. The people who live here were asked what they would like to have, and most of them said that nothing should be changed. Therefore the answer is the same as before. It is not known whether there are other reasons for it. Please look at the other side of the street, where you can see what has been done since last year. Which of these would be the best choice, and why? He took the book from the table and went away without saying a word.",
    "zh": "这是一篇关于天气和城市的短文。住在这里的人们被问到他们想要什么，大多数人说什么都不应该改变。因此答案和以前一样。目前还不知道是否有其他原因。请看街道的另一边，可以看到去年以来所做的事情。以下哪一项是最好的选择，为什么？他从桌子上拿起书，一句话也没说就走了。",
    "de": "Das ist ein kurzer Text über das Wetter und die Stadt. Die Menschen, die hier wohnen, wurden gefragt, was sie gern hätten, und die meisten sagten, dass nichts geändert werden soll. Daher lautet die Antwort wie zuvor. Es ist nicht bekannt, ob es andere Gründe dafür gibt. Bitte sehen Sie auf die andere Seite der Straße, wo man sieht, was seit dem letzten Jahr gemacht wurde. Welche Wahl wäre hier die beste, und warum? Er nahm das Buch vom Tisch und ging fort, ohne ein Wort zu sagen.",
    "fr": "Voici un petit texte sur le temps et sur la ville. On a demandé aux gens qui vivent ici ce qu'ils voudraient avoir, et la plupart ont dit que rien ne devait être changé. La réponse est donc la même qu'avant. On ne sait pas s'il y a d'autres raisons à cela. Regardez de l'autre côté de la rue, où l'on voit ce qui a été fait depuis l'année dernière. Lequel de ces choix serait le meilleur, et pourquoi ? Il prit le livre sur la table et partit sans dire un mot.",
    "es": "Este es un texto breve sobre el tiempo y la ciudad. A las personas que viven aquí se les preguntó qué les gustaría tener, y la mayoría dijo que nada debía cambiar. Por eso la respuesta es la misma que antes. No se sabe si hay otras razones para ello. Mire al otro lado de la calle, donde se ve lo que se ha hecho desde el año pasado. ¿Cuál de estas opciones sería la mejor, y por qué? Tomó el libro de la mesa y se fue sin decir una palabra.",
}

_SPLIT = re.compile(r"\n+|[。！？；]|[.!?…][)\"'”’»]?(?=\s)|[.!?](?=[一-鿿¿¡])")
_ASIDE = re.compile(r"\s*(#{1,6}(\s|$)|\*\*[^*]*\*\*\s*$|\[[^\]]*\]\s*$|<[^>]*>\s*$)")
_MARK = re.compile(r"\s*((?:[-*•]\s+)?(?:\d+[.)]\s+)|[-*•]\s+|[A-Ha-h][.)](?:\s+|$)|=>\s*)")
_ENDED = re.compile(r"[.!?。！？][\"'”’»*_]*\s*$")
_OTHER_LETTER = re.compile(r"[^\W\d_A-Za-zÀ-ɏ一-鿿㐀-䶿]")
_PLACEHOLDER = re.compile(r"[\W_]*(n/?a|tbd|todo|null|none|nil|no answer|unknown|empty|placeholder|无|暂无|待定)[\W_]*", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")
_LETTER = re.compile(r"[^\W\d_]")


def declared(lang: Column, others: tuple[str, ...] | list[str] = ()) -> Column:
    """The language that a declared value names, or null: codes and names in any case, with or without region.

    Of languages that are not listed above, those in others are known, by their code.
    """
    head = F.split(F.lower(F.trim(lang)), r"[-_ (]").getItem(0)
    out = F.when(head.isin([x for x in others if x not in NAMES]), head)
    for code, names in NAMES.items():
        out = F.when(head.isin(names), F.lit(code)).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Bounds of the sentences of a text; together they hold all but breaks between lines."""
    out, at = [], 0
    for m in _SPLIT.finditer(text):
        end = m.start() if text[m.start()] == "\n" else m.end()
        if end > at:
            out.append((at, end))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def plain(sentence: str) -> bytes | None:
    """What is scored of a sentence; None if it can have no language."""
    if _ASIDE.match(sentence) or _PLACEHOLDER.fullmatch(sentence) or not _LETTER.search(sentence):
        return None
    mark = _MARK.match(sentence)
    if mark:
        sentence = sentence[mark.end() :]
        if not _is_sentence(sentence):
            return None
    if not sentence.isascii():
        other = len(_OTHER_LETTER.findall(sentence))
        if other and other > OTHER_SCRIPT * len(_LETTER.findall(sentence)):
            return None
    out = _DIGITS.sub("0", sentence.replace("\ufffd", "")).lower().split()
    if len(out) < 2 and sentence.isascii():
        return None  # a lone word
    return " ".join(out).encode("utf-8", "replace")


def _is_sentence(item: str) -> bool:
    """Whether a list item is a sentence and not a name, an option or a value."""
    ended = _ENDED.search(item) is not None
    units = _WORD.findall(item)
    han = sum(1 for w in units if "㐀" <= w[0] <= "鿿")
    return han >= (ITEM_ENDED_HAN if ended else ITEM_HAN) or len(units) - han >= (ITEM_ENDED_WORDS if ended else ITEM_WORDS)


def train(samples: dict[str, list[str]]) -> Ppm:
    """Context trees from texts by (partly wrong) declared language, in the order given.

    A wrong label teaches a tree whole foreign sentences by heart, which code lengths then cannot tell apart. So
    the sentences are sifted first by the relative frequency of their words: a stray sentence's words are many
    times rarer under the wrong label than under the right one. Names, alike in all languages, weigh nothing.
    """
    kept: dict[str, list[bytes]] = {}
    general: dict[str, int] = {}
    for x in [*GENERAL, *sorted(x for x, texts in samples.items() if x not in GENERAL and len(texts) >= LEAST_LABELLED)]:
        kept[x] = _plain_sentences(GENERAL.get(x, ""))
        general[x] = len(kept[x])
        kept[x] += [s for t in samples.get(x, []) for s in _plain_sentences(t)]
    for _ in range(SIFT_ROUNDS):
        kept = _sift(kept, general)
    return Ppm({x: own for x, own in kept.items() if own})


def _plain_sentences(text: str) -> list[bytes]:
    return [s for a, b in sentences(text) if (s := plain(text[a:b]))]


def _words(sentence: bytes) -> list[str]:
    return _WORD.findall(sentence.decode("utf-8"))


def _sift(kept: dict[str, list[bytes]], general: dict[str, int]) -> dict[str, list[bytes]]:
    words = {x: [_words(s) for s in own] for x, own in kept.items()}
    counts = {x: Counter(w for ws in own for w in ws) for x, own in words.items()}
    usual = {w for x, c in counts.items() for w, n in c.items() if n >= max(2.0, USUAL_SHARE * len(kept[x]))}
    total = {x: sum(n for w, n in c.items() if w in usual) + 0.2 * len(usual) for x, c in counts.items()}
    cost = {x: {w: math.log((counts[x][w] + 0.2) / total[x]) for w in usual} for x in kept}

    def fits(x: str, ws: list[str]) -> bool:
        ws = [w for w in ws if w in usual]
        own = sum(cost[x][w] for w in ws)
        return all(own >= sum(cost[y][w] for w in ws) for y in kept if y != x)

    return {x: [s for i, (s, ws) in enumerate(zip(own, words[x])) if i < general[x] or fits(x, ws)] for x, own in kept.items()}


def sample_model(df: DataFrame, key: str, lang: str, fields: list[str]) -> Ppm:
    """Trees learned from at most SAMPLE_ROWS whole rows a declared language, which come to the driver."""
    order = [F.xxhash64(key), F.col(key)]
    rows = (
        df.select(F.col(key).alias("_k"), F.coalesce(declared(F.col(lang)), F.regexp_extract(F.lower(F.trim(F.col(lang))), "^([a-z]{2})([-_ (]|$)", 1)).alias("_l"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)], F.xxhash64(key).alias("_h"))
        .filter(F.col("_l") != "")
        .withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_k", *[f"_f{i}" for i in range(len(fields))])))
        .filter(F.col("_n") <= SAMPLE_ROWS)
        .drop("_h", "_k")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["_l"], r["_n"])):
        text = "\n".join(r[f"_f{i}"] for i in range(len(fields)) if r[f"_f{i}"])
        samples.setdefault(r["_l"], []).append(text)
    return train(samples)


def score_all(model: Ppm, texts: list[bytes]) -> np.ndarray:
    """Ppm.score in chunks of bounded size; each distinct text is scored once."""
    codes, uniques = pd.factorize(pd.Series(texts, dtype=object))
    parts, held, size = [], [], 0
    for t in uniques:
        if len(t) > CHUNK:
            parts += [model.score(held), model.score_long(t, CHUNK)[None]]
            held, size = [], 0
            continue
        held.append(t)
        size += len(t)
        if size > CHUNK:
            parts.append(model.score(held))
            held, size = [], 0
    parts.append(model.score(held))
    return np.concatenate(parts)[codes] if len(codes) else np.zeros((0, len(model.langs)))


def segments(model: Ppm, texts: list[str | None], bounds: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its segments (start, end, language, confidence, letters). bounds: the texts' sentences, if known."""
    where, what = [], []
    for i, t in enumerate(texts):
        for a, b in (bounds[i] if bounds else sentences(t)) if t else ():
            s = plain(t[a:b])
            if s:
                where.append((i, a, b, len(s)))
                what.append(s)
    out: list[list] = [[] for _ in texts]
    if not what:
        return out
    bits, best, sure = _judge(model, what)
    cur: list = [-1, 0, 0, "", None, 0]
    for (i, a, b, n), k, ok, row in zip(where, best, sure, bits):
        if not ok:
            continue
        if cur[0] == i and cur[3] == k:
            cur[2], cur[4], cur[5] = b, cur[4] + row, cur[5] + n
        else:
            _close(out, model, cur)
            cur = [i, a, b, k, row.copy(), n]
    _close(out, model, cur)
    return out


def _judge(model: Ppm, what: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code lengths, best language, whether that is sure) of scored sentences."""
    bits = score_all(model, what)
    order = np.sort(np.column_stack([bits, np.full(len(bits), np.inf)]), axis=1)
    return bits, np.argmin(bits, axis=1), (order[:, 1] - order[:, 0] >= MARGIN_BITS) & _known(order[:, 0], what)


def main_languages(model: Ppm, texts: list[str | None], bounds: list[list[tuple[int, int]]]) -> list[str | None]:
    """The language of most bytes of each text; of several the first by name. Sentences that cannot change it are not scored."""
    own = [sorted((s for a, b in e if (s := plain(t[a:b]))), key=len, reverse=True) if t else [] for t, e in zip(texts, bounds)]
    left, size = [sum(map(len, x)) for x in own], [{} for _ in own]
    at, out = [0] * len(own), [None] * len(own)
    wait = [i for i, x in enumerate(own) if x]
    while wait:
        upto = []
        for i in wait:
            k, need = at[i], left[i] / 2
            while k < len(own[i]) and need >= 0:
                need -= len(own[i][k])
                k += 1
            upto.append(k)
        what = [s for i, k in zip(wait, upto) for s in own[i][at[i] : k]]
        _, best, sure = _judge(model, what)
        told, more = iter(zip(best, sure)), []
        for i, k in zip(wait, upto):
            for s in own[i][at[i] : k]:
                b, ok = next(told)
                left[i] -= len(s)
                if ok:
                    x = model.langs[b]
                    size[i][x] = size[i].get(x, 0) + len(s)
            at[i] = k
            top = sorted(size[i].values(), reverse=True) + [0, 0]
            if k < len(own[i]) and top[0] - top[1] <= left[i]:
                more.append(i)
            elif size[i]:
                out[i] = max(sorted(size[i]), key=size[i].get)
        wait = more
    return out


def wholly_foreign(model: Ppm, texts: list[str | None], bounds: list[list[tuple[int, int]]], own: list[str | None]) -> list[bool]:
    """Whether each text has a language and no sentence in its own one. A text is scored up to its first sentence in that."""
    out = [False] * len(texts)
    at, seen = [0] * len(texts), [False] * len(texts)
    wait, step = [i for i, t in enumerate(texts) if t and own[i]], 1
    while wait:
        what, of = [], []
        for i in wait:
            k, n = at[i], 0
            while k < len(bounds[i]) and n < step:
                s = plain(texts[i][bounds[i][k][0] : bounds[i][k][1]])
                if s:
                    what.append(s)
                    of.append(i)
                    n += 1
                k += 1
            at[i] = k
        native = set()
        if what:
            _, best, sure = _judge(model, what)
            for i, b, ok in zip(of, best, sure):
                if ok:
                    seen[i] = True
                    if model.langs[b] == own[i]:
                        native.add(i)
        more = []
        for i in wait:
            if i in native:
                continue
            if at[i] < len(bounds[i]):
                more.append(i)
            else:
                out[i] = seen[i]
        wait, step = more, step * 2
    return out


def _known(bits: np.ndarray, what: list[bytes]) -> np.ndarray:
    """Whether the best code is better than that without any tree. Chinese characters are too many for a bound a byte."""
    size = np.fromiter(map(len, what), np.int64, len(what))
    out = bits <= NO_MODEL_BITS * size
    for i in np.flatnonzero(~out):
        s = what[i].decode("utf-8", "replace")
        out[i] = 2 * sum("㐀" <= c <= "鿿" for c in s) > sum(c.isalpha() for c in s)
    return out


def _close(out: list[list], model: Ppm, cur: list) -> None:
    i, a, b, k, row, n = cur
    if i >= 0:
        facts = max(1.0, n / LETTERS_PER_FACT)
        conf = 1.0 / np.sum(np.exp2(np.maximum(-60.0, (row[k] - row) / (facts * 4.0))))
        out[i].append((a, b, model.langs[k], float(conf), int(n)))


SEGMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("declared", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("seg_no", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def label_segments(df: DataFrame, key: str, lang: str, fields: list[str], model: Ppm | None = None) -> DataFrame:
    """One row for each language segment of each field (schema SEGMENT), in one pass without a shuffle.

    Null, empty and placeholder texts have no segment. Repeated rows give repeated segments; see distinct_segments.
    The trees (some MB, bounded by the sample) go to each worker once, as a Spark broadcast variable.
    """
    model = model or sample_model(df, key, lang, fields)
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in SEGMENT]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                rows = []
                for f in fields:
                    texts = [t if isinstance(t, str) else None for t in part[f]]
                    for rid, dec, segs in zip(part["_id"], part["_dec"], segments(m, texts)):
                        rows += [(rid, dec, f, n, *s) for n, s in enumerate(segs)]
                out = pd.DataFrame(rows, columns=names)
                out["id"] = out["id"].astype("Int64")
                yield out

    cols = [F.col(key).cast("long").alias("_id"), declared(F.col(lang), model.langs).alias("_dec"), *[F.col(f) for f in fields]]
    return df.select(*cols).mapInPandas(run, SEGMENT)


def distinct_segments(segs: DataFrame) -> DataFrame:
    """Each segment once, however often its record was delivered; deliveries of a record hold the same."""
    return segs.dropDuplicates(["id", "field", "seg_no"])


def wrong_labels(segs: DataFrame) -> DataFrame:
    """(id, field, lang) of every field whose languages are not exactly the declared one."""
    langs = segs.groupBy("id", "field").agg(F.max("declared").alias("declared"), F.collect_set("lang").alias("langs"))
    bad = (F.size("langs") > 1) | F.col("declared").isNull() | ~F.array_contains("langs", F.col("declared"))
    return langs.filter(F.size("langs") > 0).filter(bad).select("id", "field", F.explode("langs").alias("lang"))
