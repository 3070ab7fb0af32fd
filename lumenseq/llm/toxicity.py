"""Toxicity by a weighted finite-state pattern grammar.

A text's tokens become symbols: insult, doubtful insult, threat, target, negation, report, comma, quotation mark,
clause end, other. Four weighted transducers are composed into one: the first turns insults and threats shortly after a
negation into negated ones, the second those after reporting words of the same clause into reported ones, the third reads
what a clause holds, reported afterwards too ("..., he said"), and writes the clause's pattern at its end, and the fourth keeps
a pattern back where a quotation mark follows, until it is known whether a report does ("...!" he said). Arcs carry weights, which add up
along a text's path with those of its insults. A document's score is a logistic function of its patterns' counts, its path's
weight and the patterns' density, so that matched clauses count, not isolated words; the function's weights are fitted on
labelled rows, and before any are seen a word that is aimed at nobody decides nothing.

The insult lexicon is a hand-written list and what labelled rows add to it: words, and beginnings
of words, that stand in toxic texts far more often than chance allows. Words that mean something else as
often ("pig", "worm") are doubtful: they are insults only in a clause with a target, unless labelled rows show more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, texts

# Small word lists in English, French, German and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumb dumbass jerk bastard bitch whore slut asshole "
    "retard retarded vermin filth filthy parasite parasites subhuman garbage creep creeps freak freaks lowlife coward cowards pig pigs rat rats "
    "fool fools dimwit halfwit nitwit simpleton dunce buffoon cretin dolt dunderhead blockhead airhead bonehead numbskull nincompoop ignoramus degenerate scumbag sleazebag dirtbag "
    "douchebag shithead dickhead fuckface asshat jackass arsehole bastards bitches wanker tosser twat prick swine weasel worm maggot leech cockroach pest savage savages brute thug "
    "hypocrite liar crook traitor wretch wretched despicable contemptible repulsive vile revolting hideous disgrace nobody laughingstock braindead brainless spineless gutless useless "
    "connard connasse salaud salope ordure crétin abruti débile imbécile minable enfoiré bâtard pourriture raclure vaurien lâche traître menteur porc truie cafard "
    "idioten arschloch trottel abschaum dummkopf miststück schlampe wichser versager schwachkopf vollidiot blödmann drecksau schwein ratte feigling lügner verräter ungeziefer missgeburt penner nichtsnutz "
    "idiota idiotas estúpido estúpida imbécil basura escoria gilipollas cabrón puta asqueroso cabrones tonto tonta cretino cretina inútil cobarde mentiroso traidor cerdo rata alimaña parásito miserable desgraciado".split()
)
THREATS = frozenset(
    "kill murder stab shoot strangle hang burn destroy crush slaughter behead hurt beat smash choke torture mutilate gut lynch exterminate annihilate punch maim bury "
    "tuer tuerai crève crever égorger étrangler brûler frapper massacrer écraser détruire töten umbringen erschießen erwürgen verprügeln zerstören abstechen schlachten "
    "matar mataré degollar apuñalar disparar ahorcar quemar destruir golpear aplastar torturar".split()
)
TARGETS = frozenset("you your yours yourself u ur he she they them their him her his people everyone tu toi vous ton ta tes ils elles du dich dir ihr euch sie ustedes vosotros tus ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody without isn aren wasn don doesn didn won cannot neither nor ne pas jamais nicht kein keine nie niemals nunca jamás sin".split())
REPORTS = frozenset("said says say told tells wrote writes called calls claimed claims reported reports quoted quotes alleged according accused dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según".split())

# Those of these insults that have another plain meaning.
DOUBTFUL_INSULTS = frozenset(
    "pig pigs rat rats worm maggot leech cockroach pest weasel swine nobody savage savages brute thug creep creeps freak freaks jerk fool fools crook traitor tosser prick useless dumb "
    "ordure truie porc cafard traître menteur schwein ratte penner ungeziefer verräter lügner cerdo rata basura tonto tonta miserable cobarde traidor".split()
)

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n,\"“”„«»]")
WORD = re.compile(r"[^\W\d_]+")
ENDS = frozenset(".!?;\n")
QUOTES = frozenset('"“”„«»')
STEMS = range(4, 9)
REACH = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, COMMA, QUOTE, DOUBTFUL, END, STOP, NEGATED, REPORTED = range(13)
#: What a text's tokens can be; NEGATED and REPORTED only pass between transducers.
N_SYMBOLS = STOP + 1
HARMFUL = frozenset([INSULT, THREAT, DOUBTFUL])
PATTERNS = ("threat_targeted", "threat", "insult_targeted", "insult", "reported", "negated")
#: Weights of the patterns' arcs; an insult's own weight is added where it is read.
ARCS = (4.0, 1.5, 1.5, 0.0, -3.0, -3.0)
#: The training sample's bound in rows. The learned lexicon holds words of the sample only.
SAMPLE_ROWS = 12000
#: A learned entry needs this much evidence, in nats: the logarithm of the entries tested.
EVIDENCE = 12.0


class Transducer(NamedTuple):
    """A weighted finite-state transducer: its start, and step(state, symbol) -> (state, output, weight)."""

    start: object
    step: Callable


def negation() -> Transducer:
    """Insults and threats within REACH words after a negation are written as negated."""

    def step(left: int, symbol: int):
        if symbol == NEGATION:
            return REACH, symbol, 0.0
        if symbol in (END, STOP):
            return 0, symbol, 0.0
        if symbol in (COMMA, QUOTE):
            return left, symbol, 0.0
        return max(0, left - 1), NEGATED if left and symbol in HARMFUL else symbol, 0.0

    return Transducer(0, step)


def report() -> Transducer:
    """Insults and threats after a reporting word of their clause are written as reported."""

    def step(told: bool, symbol: int):
        if symbol in (REPORT, END, STOP):
            return symbol == REPORT, symbol, 0.0
        return told, REPORTED if told and symbol in HARMFUL else symbol, 0.0

    return Transducer(False, step)


NOTHING, SAID, QUOTED, STOPPED = "nothing", "said", "quoted", "stopped"


def clause() -> Transducer:
    """At a clause's end the pattern that it shows, an index of PATTERNS, or -1 for none; its arc carries the pattern's weight.

    A reporting word within REACH words after a comma makes what the clause held before it reported. Reporting words, quotation marks
    and the text's end are passed on, as is NOTHING for all else.
    """

    def pattern(seen: frozenset) -> int:
        aimed = TARGET in seen
        if THREAT in seen and (aimed or INSULT in seen):
            return 0 if aimed else 1
        if INSULT in seen or (DOUBTFUL in seen and aimed):
            return 2 if aimed else 3
        return 4 if REPORTED in seen else 5 if NEGATED in seen else -1

    def step(state: tuple[frozenset, int], symbol: int):
        seen, since = state
        if symbol in (END, STOP):
            found = pattern(seen)
            return (frozenset(), 0), STOPPED if symbol == STOP else found, 0.0 if found < 0 or symbol == STOP else ARCS[found]
        if symbol == COMMA:
            return (seen, REACH), NOTHING, 0.0
        if symbol == REPORT:
            told = frozenset(REPORTED if x in HARMFUL else x for x in seen) if since else seen
            return (told, 0), SAID, 0.0
        if symbol == QUOTE:
            return state, QUOTED, 0.0
        return (seen | {symbol} if symbol in HARMFUL or symbol in (TARGET, NEGATED, REPORTED) else seen, max(0, since - 1)), NOTHING, 0.0

    return Transducer((frozenset(), 0), step)


def afterwards() -> Transducer:
    """The patterns of clauses, each written one symbol later, -1 for none. A pattern before a closing quotation mark waits for up to
    REACH words, and is written as reported if one of them is a reporting word."""

    def step(state: tuple[int, int], symbol):
        held, left = state
        if symbol == QUOTED and held >= 0:
            return (held, REACH), -1, 0.0
        if symbol == SAID and left:
            return (-1, 0), 4, ARCS[4] - ARCS[held]
        if symbol == STOPPED:
            return (-1, 0), held, 0.0
        if symbol in (NOTHING, SAID, QUOTED):
            return ((held, left - 1), -1, 0.0) if left > 1 else ((-1, 0), held, 0.0)
        return (symbol, 0), held, 0.0

    return Transducer((-1, 0), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the first one's output to the second; weights add up."""

    def step(state, symbol):
        a, middle, x = first.step(state[0], symbol)
        b, out, y = second.step(state[1], middle)
        return (a, b), out, x + y

    return Transducer((first.start, second.start), step)


def compiled(machine: Transducer) -> list[list[tuple[int, int, float]]]:
    """A table of all reachable states: table[state][symbol] = (state, output, weight); 0 is the start."""
    number, table, todo = {machine.start: 0}, [], [machine.start]
    for state in todo:
        row = []
        for symbol in range(N_SYMBOLS):
            after, out, weight = machine.step(state, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], out, weight))
        table.append(row)
    return table


GRAMMAR = compiled(compose(negation(), compose(report(), compose(clause(), afterwards()))))


class Lexicon(NamedTuple):
    """Insults with weights; a stem stands for every word that begins with it."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        """0 for a word that is no insult."""
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        return best


SEED = Lexicon(dict.fromkeys(INSULTS, 3.0), {})
PLAIN = {
    **dict.fromkeys(THREATS, THREAT),
    **dict.fromkeys(TARGETS, TARGET),
    **dict.fromkeys(NEGATIONS, NEGATION),
    **dict.fromkeys(REPORTS, REPORT),
    **dict.fromkeys(ENDS, END),
    **dict.fromkeys(QUOTES, QUOTE),
    ",": COMMA,
}
SILENT = frozenset([COMMA, QUOTE, END])
N_FEATURES = len(PATTERNS) + 5
#: What the weights are before any label is seen: aimed patterns make a text toxic; insults at nobody, reported and negated ones hardly.
PRIOR = np.array([1.5, 0.4, 1.5, 0.4, 0.1, 0.1, 2.0, 0.2, 0.3, 0.3, 0.0])


def features(text: str, lexicon: Lexicon) -> np.ndarray | None:
    """The counts of a text's patterns, whether one is aimed, whether another matches, the weight of its path, their density; None if no clause matches.

    A text of whatever length is read once, token by token.
    """
    lowered = text.lower()
    distinct = set(WORD.findall(lowered))
    insults = {w: s for w in distinct if (s := lexicon.weight(w))}
    if not insults and distinct.isdisjoint(THREATS):
        return None
    symbols = {**PLAIN, **{w: DOUBTFUL if w in DOUBTFUL_INSULTS and s <= SEED.words[w] else INSULT for w, s in insults.items()}}
    counts, path, words, state = [0] * len(PATTERNS), 0.0, 0, 0
    read = chain((symbols.get(m[0], OTHER) if (w := insults.get(m[0])) is None else (symbols[m[0]], w) for m in TOKEN.finditer(lowered)), (END, STOP))
    for symbol in read:
        if type(symbol) is tuple:
            symbol, weight = symbol
            path += weight if symbol == INSULT else 0.0
        words += symbol not in SILENT
        state, pattern, weight = GRAMMAR[state][symbol]
        path += weight
        if pattern >= 0:
            counts[pattern] += 1
    if not sum(counts):
        return None
    aimed, loose = counts[0] + counts[2], counts[1] + counts[3]
    return np.array([*np.log1p(counts), aimed > 0, loose > 0, log(1 + max(0.0, path)), log((aimed + loose + 0.05) / (words + 40)) + 5, 1.0])


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        x = features(text, self.lexicon) if text else None
        z = self.bias + (0.0 if x is None else float(x @ self.weights))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def fit(rows: list[np.ndarray | None], labels: np.ndarray, rounds: int = 30, stiffness: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, drawn towards PRIOR and a bias of -3."""
    x = np.array([np.append(r, 1.0) if r is not None else np.append(np.zeros(N_FEATURES), 1.0) for r in rows] or np.zeros((0, N_FEATURES + 1)))
    centre = np.append(PRIOR, -3.0)
    w = centre.copy()
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + stiffness * (w - centre)
        curve = (x * (p * (1 - p))[:, None]).T @ x + stiffness * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame, training: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about `most` labelled training rows, chosen by hashed id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rate = most / max(most, known.count())
    picked = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(rate * (1 << 20)))
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def learned_lexicon(sample: DataFrame, evidence: float = EVIDENCE) -> Lexicon:
    """SEED and the words and stems that the sample's toxic texts show beyond chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in batches:
            for data, label in zip(texts(batch), batch.column(1).to_pylist()):
                words = {w for w in WORD.findall(data.decode("utf-8", "replace").lower()) if len(w) >= STEMS[0]}
                keys = words | {w[:n] + "*" for w in words for n in STEMS if n <= len(w)} | {" "}
                every.update(keys)
                if label:
                    toxic.update(keys)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[k] for k in every], pa.int64())], ["key", "n", "bad"])

    sums = sample.mapInArrow(run, "key string, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    likely = sums.where("key = ' ' or (bad >= 4 and bad >= 0.7 * n)").orderBy("key").collect()
    total = next(((r.n, r.bad) for r in likely if r.key == " "), (0, 0))
    words, stems, bad = dict(SEED.words), {}, {}
    base = (total[1] + 0.5) / (total[0] + 1)
    for r in likely:
        share = (r.bad - 0.25) / r.n
        beyond = r.n * (share * log(share / base) + (1 - share) * log((1 - share) / (1 - base)))
        if r.key != " " and share > base and beyond > evidence:
            (stems if r.key.endswith("*") else words)[r.key.rstrip("*")] = log(share / (1 - share)) + 1.5
            bad[r.key] = r.bad
    alone = {s for s in stems if any(w.startswith(s) and 10 * n > 7 * bad[s + "*"] for w, n in bad.items() if not w.endswith("*"))}
    return Lexicon(words, {s: x for s, x in stems.items() if s not in alone})  # such a stem is one word, and that is known


def learn(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """A model fitted on a bounded sample of labelled training rows; with none, the prior alone."""
    sample = checkpointed(labelled(docs, labels, training))
    lexicon = learned_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.decode("utf-8", "replace"), lexicon) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([None if r is None else r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "toxic"])

    found = sample.mapInArrow(run, "x array<double>, toxic int").collect()
    return Model(lexicon, *fit([r.x and np.array(r.x) for r in found], np.array([r.toxic for r in found], float)))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row from its whole text; null counts as empty.

    Texts without a matched clause, empty ones too, get the base score. Repeated rows get equal
    scores. predicted is 1 from a score of 0.7 on.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(x.decode("utf-8", "replace")) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
