"""Abusive, hateful and sexual statements, by weak supervision.

Many voters (word lists and patterns, in several languages) vote on each sentence.  A generative label model estimates
from the counts of all vote patterns in the corpus how accurate each voter is and which voters depend on each other.
Its posteriors are the labels on which a linear classifier over hashed words and word pairs is trained; the classifier
scores every sentence, and a document's score is that of its worst sentence.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirestack.llm.canon import canonical_points
from quirestack.operators.nested import byte_chunks
from quirestack.session import bounded, cut

#: Labelled documents, and distinct sentences with and without a vote, that the models are fitted on at most.
LABELLED, VOTED_SAMPLE, SILENT_SAMPLE = 20_000, 60_000, 20_000
#: Sentences of documents that annotators call unsafe, and distinct ones with and without a vote of those they call safe, that the classifier is fitted on at most.
UNSAFE_SAMPLE, SAFE_VOTED_SAMPLE, SAFE_SAMPLE = 60_000, 20_000, 60_000
#: What voters say of the whole corpus weighs like the judgements on so many documents.
VOTERS_WEIGH = 150
BITS = 22
THRESHOLD = 0.5
#: Features added to a sentence's size, so that a few words alone weigh little.
SHORT = 8

# The voters' word lists, common words of each kind in several languages.  Several words in a row are a
# phrase; words are lower case, without accents.
LISTS = {
    "you": "you your youre yours yourself yourselves u ur du dich dir dein deine deinen deiner euch ihr eure tu toi te ta ton tes vous votre vos tuyo eres tus ti contigo usted ustedes vosotros voce sei tuo tua je jij jouw ty twoj sen senin ты тебя тебе твой твоя вы вас",
    "person": "he she him her his hers everybody nobody somebody people man men woman women girl girls boy boys guy guys lady mother mom wife husband sister brother son daughter neighbour neighbor mutter frau mann mere femme homme fille madre mujer hombre alguien personne jemand",
    "group": "peoples folk folks race races breed tribe immigrants migrants foreigners refugees muslims jews christians blacks whites asians arabs gypsies gays lesbians homosexuals disabled all_of_them they_all these_people those_people that_lot every_one_of_them their_kind your_kind your_lot alle_diese auslander fremde tous_ces ces_gens etrangers immigres todos_esos esa_gente inmigrantes people their_race that_race whole_race their_blood their_sort",
    "insult": "idiot idiots idiotic moron morons stupid dumb fool fools imbecile cretin bastard bastards halfwit dimwit nitwit maggot scum garbage trash worthless pathetic ugly disgusting clown loser losers pig pigs swine worm cockroach parasite parasites vermin rat rats filthy dirty filth liar liars thief thieves coward cowards disgrace animals inferior retard retarded freak creep jerk asshole bitch bitches whore slut cunt dick prick wanker twat shit shithead fucker fucking dumbass brainless subhuman scumbag lowlife degenerate savages repulsive vile stinking",
    "strong": "scumbag scumbags pervert perverts creep moron morons imbecile cretin bastard bastards halfwit dimwit nitwit asshole assholes bitch bitches whore whores slut sluts cunt cunts wanker wankers twat retard retards subhuman subhumans untermensch fucker motherfucker dickhead shithead dumbass douchebag jackass lowlife connard connasse salaud salope ordure encule batard abruti arschloch wichser fotze hurensohn missgeburt schlampe drecksau dummkopf vollidiot hijo_de_puta cabron gilipollas pendejo puta puto bastardo maricon mierda_de filho_da_puta caralho stronzo bastardo vaffanculo klootzak kurwa сука блядь мразь ублюдок",
    "foreign_insult": "dumm dumme dummer blod idioten trottel depp versager widerlich widerlicher ekelhaft abschaum dreck dreckig drecksau schwein schweine maul schlampe gesindel ungeziefer lugner feigling wertlos cretin connard ordure pauvre gueule vermine voleur voleurs menteur crapule dechet racaille degueulasse imbecil inutil maldito asco basura idiota ladron ladrones mentiroso cobarde estupido estupida cerdo cerda asqueroso escoria hurensohn salope putain idiota cretino schifo feccia lixo идиот дурак тварь урод",
    "threat": "where_you_live watch_your_back get_hurt get_you_for_this come_for_you coming_for_you i_hope_you hope_you_die hope_you_suffer hope_he_dies hope_she_dies hope_they kill_you kill_him kill_her kill_them kill_yourself kill_your murder_you beat_you beat_you_up hurt_you find_you hunt_you break_your break_every cut_your slit_your your_throat smash_your bash_your punch_you stab_you shoot_you shoot_them hang_them gas_them burn_them burn_you_alive exterminate_them wiped_out driven_out send_them_back back_where_they_came deport_them should_be_shot should_be_hanged should_all_die deserve_to_die deserves_to_die better_off_dead you_are_dead you_will_regret you_will_pay make_you_pay rot_in_hell burn_in_hell drop_dead go_die bringe_dich_um bring_dich_um schlage_dich breche_dir ich_finde_dich verrecke stirb_endlich je_vais_te_tuer te_tuer te_casser va_crever creve va_mourir te_voy_a_matar te_mato te_mataria ojala_te muerete vete_al_infierno te_voy_a_encontrar ti_ammazzo vou_te_matar",
    "dismiss": "shut_your shut_up your_mouth get_lost go_to_hell crawl_back screw_you fuck_off fuck_you piss_off get_out_of_here nobody_wants_you nobody_likes_you ferme_ta ta_gueule la_gueule degage va_te_faire halt_dein halt_die dein_maul die_fresse verschwinde verpiss_dich hau_ab cierra_la la_boca largate vete_a_la callate cala_a_boca",
    "dehuman": "vermin parasites liars thieves filthy inferior criminals rapists savages animals cockroaches plague infest infestation invaders subhuman exterminated deported driven wiped cleansed never_trust cannot_be_trusted all_the_same ungeziefer vertrieben raus abschieben verbrecher schmarotzer vermine parasites chasse dehors voleurs criminels basura parasitos ladrones fuera expulsar less_than_human",
    "sex_strong": "porn porno pornographic orgasm orgasms orgasmic horny nudes blowjob handjob cumshot dildo masturbate masturbating masturbation pussy tits titties boobs uncensored erotic xxx milf threesome gangbang hardcore_sex anal_sex oral_sex camgirl camgirls cam_girls escort_girls sexting geile geile_frauen nackte nackt cachonda cachondo desnuda desnudo desnudas baise baiser chatte fick ficken titten muschi polla tetas foder buceta scopare troia порно секс naked_girls naked_women hot_girls",
    "sex": "naked nude nudes nudity sex sexual sexy bed undressed undress undressing stripped strip striptease thigh thighs breast breasts nipples buttocks panties lingerie kiss kissed kissing lick licked licking suck sucked moan moaned moaning thrusting climaxed aroused arousal seduce seduced lust caress caressed grope groped genitals nackt nackte brust bruste schenkel stohnen sexo pechos piernas beso gemidos seins cuisses caresse caresser gemir wet lips legs lover lovers mouth",
    "violence": "break bones neck hurt choke die dead death kill killed murder beat burn stab shoot hell blood throat knife gun bullet corpse strangle drown smash brechen tot tod toten blut messer mort mourir tuer sang couteau muerte morir matar sangre cuchillo",
    "technical": "data dataset model models algorithm method methods analysis study studies experiment experiments results result figure table section theorem lemma proof equation sample samples variable variables parameter parameters process processes system systems server memory code software file files function class classes network training test tests baseline patients clinical cells cell mice species protein gene temperature pressure reaction solvent energy statistical estimate estimates measured measurement corpus annotation classifier detector filter paper authors literature quoted dictionary linguistics",
}
VOTERS = ("insult_you", "strong", "foreign_you", "foreign_pair", "threat", "threat_pair", "dismiss", "group", "group_pair", "insult_person", "insult_pair", "sex_strong", "sex_person", "sex_pair", "sex_triple", "violence_you", "masked", "technical", "number", "nobody", "annotated_safe", "annotated_unsafe")
FIRST_NEGATIVE = VOTERS.index("technical")
#: The voters for each kind of unsafe sentence: insults, threats and contempt of groups, sexual ones.
KINDS = (
    {"insult_you", "strong", "foreign_you", "foreign_pair", "dismiss", "insult_person", "insult_pair", "masked", "annotated_unsafe"},
    {"threat", "threat_pair", "group", "group_pair", "foreign_pair", "violence_you", "annotated_unsafe"},
    {"sex_strong", "sex_person", "sex_pair", "sex_triple", "masked", "annotated_unsafe"},
)
NEGATIVE = {"technical", "number", "nobody", "annotated_safe"}
#: The bits of voters for and of annotators.
SPOKEN = (1 << FIRST_NEGATIVE) - 1
ANNOTATED = 1 << VOTERS.index("annotated_safe") | 1 << VOTERS.index("annotated_unsafe")

_MIX = np.uint64(0x9E3779B97F4A7C15)
NUMBER = np.uint64(0x5DEECE66D)


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case letters without accents; 0: dropped, 1: white space, 2-11: digits; the top bit: signs used as letters."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        if ch.isspace():
            out[cp] = 1
        elif ch.isdecimal():
            out[cp] = 2 + unicodedata.decimal(ch)
        elif ch.isalpha():
            base = unicodedata.normalize("NFD", ch.lower())[0]
            out[cp] = ord(base)
    return out


#: Digits and signs that stand for letters inside a word.
LEET = dict(zip("0134578@$!|", "oieastbasil", strict=True))


class Sentences:
    """The words of a batch of texts, by sentence: word values, and for each sentence its text, first word and flags."""

    def __init__(self, texts: pa.Array) -> None:
        points, ends = canonical_points(texts, tidy=False)
        kind = _letters()[points]
        space = kind == 1
        # letters set apart by single blanks are one word
        alone = (kind > 11) & np.r_[True, space[:-1]] & np.r_[space[1:], True]
        run = np.zeros(len(points), bool)
        if len(points) > 4:
            inner = space[2:-2] & alone[1:-3] & alone[3:-1]
            run[2:-2] = inner & ((np.r_[False, False, alone[1:-5]] if len(points) > 6 else False) | (np.r_[alone[5:-1], False, False] if len(points) > 6 else False))
        space &= ~run
        stop = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
        first_char = np.zeros(len(points), bool)
        first_char[ends[:-1][ends[:-1] < len(points)]] = True
        newline = (points == 10) | ((points == 13) & np.r_[points[1:] != 10, True]) if len(points) else points == 10
        # a line end after nothing but white space since the one before
        ink = np.maximum.accumulate(np.where(space & ~newline, -1, np.arange(len(points)))) if len(points) else newline
        blank_line = newline & np.r_[False, newline[ink[:-1]]] if len(points) else newline
        closes = (np.r_[False, stop[:-1]] & space) | blank_line | first_char
        sentence = np.cumsum(closes)
        word = np.cumsum(space | first_char)
        digit = (kind > 1) & (kind < 12)
        sign = (points == ord("@")) | (points == ord("$")) | (points == ord("!")) | (points == ord("|"))
        letter = kind > 11
        # a word with a letter reads its digits and signs as letters; a word of digits is a number
        has = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
        has[word[letter]] = True
        in_word = has[word] if len(word) else np.zeros(0, bool)
        nxt_letter = np.r_[letter[1:], False] & ~np.r_[space[1:], True]
        sign &= in_word & (nxt_letter | np.r_[False, letter[:-1]]) & ~((points == ord("!")) & ~nxt_letter)
        leet = np.zeros(128, np.uint32)
        for a, b in LEET.items():
            leet[ord(a)] = ord(b)
        as_letter = (digit & in_word & (points < 128)) | sign
        value = np.where(as_letter, leet[np.minimum(points, 127)], kind)
        value = np.where(letter, kind, np.where(as_letter, value, 0))
        star = (points == ord("*")) & np.r_[False, letter[:-1]] & np.r_[letter[1:] | (points[1:] == ord("*")), False]
        masked_word = np.zeros(len(has), bool)
        masked_word[word[star]] = True
        masked_word[word[(sign | (digit & in_word)) & np.r_[False, letter[:-1]] & nxt_letter]] = True
        keep = value > 11
        same = np.r_[False, (value[1:] == value[:-1]) & (word[1:] == word[:-1])] & keep
        triple = same & np.r_[False, same[:-1]]
        masked_word[word[triple]] = True
        keep &= ~same  # doubled letters count once
        numbers = np.zeros(len(has), bool)
        numbers[word[digit & ~in_word]] = True
        chars, owner = value[keep].astype(np.uint64), word[keep]
        head = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        start = np.flatnonzero(head)
        place = np.arange(len(chars)) - np.repeat(start, np.diff(np.r_[start, len(chars)])) if len(start) else np.zeros(0, np.int64)
        x = _mix(chars, place)
        values = np.add.reduceat(x, start) if len(start) else np.zeros(0, np.uint64)
        at_word = owner[start] if len(start) else np.zeros(0, np.int64)
        first_of_word = np.full(len(has), len(points), np.int64)
        if len(points):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            first_of_word[word[heads]] = heads
        num_words = np.flatnonzero(numbers)
        ids = np.concatenate([at_word, num_words])
        values = np.concatenate([values, np.full(len(num_words), NUMBER)])
        order = np.argsort(ids, kind="stable")
        ids, self.values = ids[order], values[order]
        position = np.minimum(first_of_word[ids], max(0, len(points) - 1))
        # the sentence of a word is that of its last white space or start
        owner_sentence = sentence[position] if len(points) else np.zeros(0, np.int64)
        uniq, self.first = np.unique(owner_sentence, return_index=True)
        self.size = np.diff(np.r_[self.first, len(ids)])
        self.sentence = np.repeat(np.arange(len(uniq)), self.size)
        self.text = np.searchsorted(ends, position[self.first], "right") - 1 if len(uniq) else np.zeros(0, np.int64)
        self.masked = self._any(masked_word[ids])
        starred = np.zeros(len(has), bool)
        starred[word[star]] = True
        starred[word[run]] = True
        self.starred = starred[ids]
        self.hidden = np.zeros(len(self.first), bool)
        if self.starred.any():
            at = np.flatnonzero(self.starred)
            self.hidden = self._any_at(at[_member(self.values[at], _gapped())])
        self.number = self._any(self.values == NUMBER)

    def _any(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence[flag], minlength=len(self.first)) > 0 if len(self.first) else np.zeros(0, bool)

    def _any_at(self, at: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence[at], minlength=len(self.first)) > 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word with the next one of its sentence: their value and the sentence."""
        same = self.sentence[1:] == self.sentence[:-1] if len(self.sentence) > 1 else np.zeros(0, bool)
        return (self.values[:-1][same] * _MIX + self.values[1:][same]), self.sentence[1:][same]

    def hits(self) -> dict[str, np.ndarray]:
        """For each list how many of its words and phrases each sentence has: one look-up for each phrase length."""
        out = {name: np.zeros(len(self.first), np.int64) for name in LISTS}
        rolled = np.zeros(len(self.values), np.uint64)
        for length, (codes, lists) in _phrases().items():
            n = len(self.values) - length + 1
            if n < 1:
                break
            rolled = rolled[:n] * _MIX + self.values[length - 1 :]
            at = np.minimum(np.searchsorted(codes, rolled), len(codes) - 1)
            hit = np.flatnonzero((codes[at] == rolled) & (self.sentence[:n] == self.sentence[length - 1 :]))
            bits, owner = lists[at[hit]], self.sentence[:n][hit]
            for i, name in enumerate(LISTS):
                out[name] += np.bincount(owner[(bits >> i & 1) > 0], minlength=len(self.first))
        return out

    def votes(self, annotated: np.ndarray | None = None) -> np.ndarray:
        """Bit mask of the voters that speak on each sentence; ``annotated`` is the share of annotators against its text (nan: none)."""
        h = self.hits()
        you, person = h["you"] > 0, h["person"] > 0
        v = {
            "insult_you": (h["insult"] > 0) & you, "strong": (h["strong"] > 0) | self.hidden, "foreign_you": (h["foreign_insult"] > 0) & you, "foreign_pair": h["foreign_insult"] > 1,
            "threat": h["threat"] > 0, "threat_pair": h["threat"] > 1, "dismiss": h["dismiss"] > 0, "group": (h["group"] > 0) & (h["dehuman"] > 0), "group_pair": (h["dehuman"] > 1),
            "insult_person": (h["insult"] > 0) & person, "insult_pair": h["insult"] > 1, "sex_strong": h["sex_strong"] > 0, "sex_person": (h["sex"] > 0) & (person | you), "sex_pair": h["sex"] > 1, "sex_triple": h["sex"] > 2, "violence_you": (h["violence"] > 0) & you, "masked": self.masked,
        }
        spoken = functools.reduce(np.logical_or, [x for k, x in v.items() if k != "masked"]) if len(self.first) else np.zeros(0, bool)
        v |= {"technical": h["technical"] > 0, "number": self.number, "nobody": ~(you | person | (h["group"] > 0))}
        share = np.full(len(self.first), np.nan) if annotated is None else annotated[self.text]
        v |= {"annotated_safe": share < 0.5, "annotated_unsafe": (share > 0.5) & spoken}
        return sum((v[k].astype(np.int64) << i for i, k in enumerate(VOTERS)), np.zeros(len(self.first), np.int64))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words and pairs of words: feature numbers and their sentences."""
        pair, at = self.pairs()
        f = np.concatenate([_slot(self.values), _slot(pair ^ np.uint64(0xABCDEF))])
        return f, np.concatenate([self.sentence, at])

    def features_of(self, i: int) -> np.ndarray:
        """The feature numbers of one sentence."""
        v = self.values[self.first[i] : self.first[i] + self.size[i]]
        return np.concatenate([_slot(v), _slot((v[:-1] * _MIX + v[1:]) ^ np.uint64(0xABCDEF))]).astype(np.int32)

    def priority(self) -> np.ndarray:
        """A random order of the sentences that depends on their words alone: sentences of the same words share a place."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        x = np.add.reduceat(self.values * np.uint64(0xD6E8FEB86659FD93), self.first)
        x = (x ^ (x >> np.uint64(31))) * _MIX
        return (x >> np.uint64(1)).astype(np.int64)


def _mix(chars: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = (chars + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slot(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64)


def _member(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(codes, values), len(codes) - 1)
    return codes[at] == values


@functools.cache
def _phrases() -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words, in order: the sorted values of all listed phrases and which lists have them, as bits."""
    by: dict[int, dict[int, int]] = {}
    phrases = [(i, phrase.replace("_", " ")) for i, text in enumerate(LISTS.values()) for phrase in text.split()]
    s = Sentences(pa.array([p for _, p in phrases]))
    for (i, _), first, size in zip(phrases, s.first, s.size, strict=True):
        words = s.values[first : first + size]
        code = np.zeros(1, np.uint64)
        for k in range(len(words)):
            code = code * _MIX + words[k : k + 1]
        held = by.setdefault(len(words), {})
        held[int(code[0])] = held.get(int(code[0]), 0) | 1 << i
    longest = max(by)
    return {n: (np.array(sorted(by.get(n, {0: 0})), np.uint64), np.array([by.get(n, {0: 0})[c] for c in sorted(by.get(n, {0: 0}))], np.int64)) for n in range(1, longest + 1)}


@functools.cache
def _gapped() -> np.ndarray:
    """Values of what is left of a listed word when up to four of its inner letters are starred out."""
    words = {w for name in ("insult", "strong", "foreign_insult", "sex_strong", "sex") for w in LISTS[name].split() if "_" not in w and len(w) > 3}
    left = {w[:i] + w[i + n :] for w in words for n in range(1, 5) for i in range(1, len(w) - n)}
    left |= words | {"a" + w for w in words}  # letters set apart may have taken in the article before them
    return np.unique(Sentences(pa.array(sorted(w for w in left if len(w) > 1))).values)


class LabelModel:
    """Latent classes: safe sentences and three kinds of unsafe ones; each voter speaks with a probability of its own in each.

    The kinds account for voters that go together (a sexual sentence says nothing about threats).  Voters that stay
    correlated within the classes share their weight.  A voter against that is silent says nothing.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> None:
        x = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
        w = counts.astype(float)
        self.against = np.array([v in NEGATIVE for v in VOTERS])
        base = (x * w[:, None]).sum(0) / w.sum()
        # before any data: voters for a kind speak far more often on its sentences than on others, those against less than half as often
        self.p = np.empty((1 + len(KINDS), len(VOTERS)))
        self.p[0] = np.clip(np.where(self.against, base, base * 0.2), 1e-6, 0.98)
        for c, kind in enumerate(KINDS, 1):
            own = np.array([v in kind for v in VOTERS])
            self.p[c] = np.clip(np.where(self.against, base * 0.4, np.where(own, np.maximum(base * 20, 0.2), np.maximum(base * 2, 0.02))), 1e-4, 0.9)
        self.prior = np.array([1 - 0.002 * len(KINDS), *[0.002] * len(KINDS)])
        self.share = np.ones(len(VOTERS))
        first, weight = self.p.copy(), np.array([300.0, *[30.0] * len(KINDS)])  # the starting values count like so many sentences
        for r in range(rounds):
            q = self.classes(patterns)
            each = (w[:, None] * q).sum(0)
            self.p = np.clip(((w[:, None] * q).T @ x + weight[:, None] * first) / (each + weight)[:, None], 1e-6, 0.995)
            self.prior = (each + 1) / (w.sum() + len(self.p))
            if r % 10 == 9:
                self._shares(x, w, q)

    def _shares(self, x: np.ndarray, w: np.ndarray, q: np.ndarray) -> None:
        """The more a voter is correlated with others within a class, the less of its weight counts."""
        total = np.zeros((x.shape[1], x.shape[1]))
        for c in range(len(self.p)):
            d = x - self.p[c]
            cov = (d * (w * q[:, c])[:, None]).T @ d
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total = np.maximum(total, cov / sd[:, None] / sd[None, :])
        self.correlation = np.where(total > 0.3, total, 0.0)
        np.fill_diagonal(self.correlation, 1.0)
        self.share = np.maximum(1 / np.sqrt(self.correlation.sum(1)), 0.5)

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of each class for each vote pattern."""
        x = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(bool)
        score = np.log(self.prior)[None, :].repeat(len(x), 0)
        for c in range(len(self.p)):
            yes = np.log(self.p[c] / self.p[0])
            no = np.where(self.against, 0.0, np.log((1 - self.p[c]) / (1 - self.p[0])))
            score[:, c] += (np.where(x, yes, no) * self.share).sum(1)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of each vote pattern that its sentences are unsafe."""
        return 1 - self.classes(patterns)[:, 0]


class Linear:
    """Logistic regression on hashed features, by Adagrad on soft labels.

    After each of the ``rounds`` but the last ``relabel`` may give new labels for the scores so far.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: tuple[int, ...] = (50,), decay: float = 5e-7, relabel: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        self.b = -3.0
        self.w = np.zeros(1 << BITS)
        if not rows:
            return
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows)
        place = np.zeros(1 << BITS, np.int32)
        place[flat] = 1
        slots = np.flatnonzero(place)  # only the slots that occur
        place[slots] = np.arange(len(slots), dtype=np.int32)
        w = np.zeros(len(slots))
        g = np.full(len(slots), 1e-2)
        gb = 1e-2
        rng = np.random.default_rng(7)
        start = np.r_[0, np.cumsum(size)]
        norm = 1 / np.sqrt(size + SHORT)
        parts = []
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
            n = size[part]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(start[part] - (ends - n), n)
            used, f = np.unique(place[flat[at]], return_inverse=True)
            parts.append((part, used, f.astype(np.int32), np.repeat(np.arange(len(part), dtype=np.int32), n)))
        score = np.zeros(len(rows))
        for stage, times in enumerate(rounds):
            if stage and relabel is not None:
                for part, used, f, r in parts:
                    score[part] = _logistic(np.bincount(r, w[used][f], len(part)) * norm[part] + self.b)
                labels = relabel(score)
            for k in np.concatenate([rng.permutation(len(parts)) for _ in range(times)]):
                part, used, f, r = parts[k]
                z = np.bincount(r, w[used][f], len(part)) * norm[part] + self.b
                e = (_logistic(z) - labels[part]) * weights[part]
                step = np.bincount(f, (e * norm[part])[r], len(used)) + decay * len(part) * w[used]
                g[used] += step**2
                w[used] -= 0.5 * step / np.sqrt(g[used])
                gb += e.sum() ** 2
                self.b -= 0.3 * e.sum() / np.sqrt(gb)
        self.w[slots] = w

    def score(self, s: Sentences) -> np.ndarray:
        f, at = s.features()
        size = np.bincount(at, minlength=len(s.first))
        return _logistic(np.bincount(at, self.w[f], len(s.first)) / np.sqrt(size + SHORT) + self.b)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: What a gathered sentence stands for: one of a document without judgement that has a vote or none, one of a document that
#: annotators call safe, likewise, or one of a document that they call unsafe or are divided on.
#: Twins are sentences of unsafe documents that safe ones have too.
VOTED, SILENT, SAFE_VOTED, SAFE_SILENT, IN_UNSAFE, TWIN = range(6)
BOUNDS = (VOTED_SAMPLE, SILENT_SAMPLE, SAFE_VOTED_SAMPLE, SAFE_SAMPLE)
#: Rows that only count: sentences by vote pattern, documents that annotators call safe by their sentences with and without a vote, all documents.
PATTERN, SAFE_VOTED_COUNT, SAFE_SILENT_COUNT, DOCUMENTS = -1, -2, -3, -4
GATHERED = "kind int, pattern long, n long, priority long, document long, slots array<int>"


class _Pool:
    """The distinct sentences of least priority, at most ``most`` of them, each with the number of its documents."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.least = most, {}, None

    def add(self, s: Sentences, at: np.ndarray, priority: np.ndarray, votes: np.ndarray, document: np.ndarray) -> None:
        if self.least is not None:
            at = at[priority[at] <= self.least]
        order = at[np.lexsort((document[at], votes[at], priority[at]))]
        first = np.flatnonzero(np.r_[True, np.diff(priority[order]) != 0]) if len(order) else order
        count = np.diff(np.r_[first, len(order)])
        for i, n in zip(order[first[: self.most]].tolist(), count[: self.most].tolist(), strict=True):
            p, mine = int(priority[i]), (int(votes[i]), int(document[i]))
            old = self.held.get(p)
            # of equal sentences the same one wherever they come from
            self.held[p] = (*mine, n, s.features_of(i)) if old is None else (*min(mine, old[:2]), n + old[2], old[3])
        if len(self.held) > 2 * self.most:
            kept = sorted(self.held)[: self.most]
            self.held, self.least = {p: self.held[p] for p in kept}, kept[-1]

    def rows(self, kind: int) -> list[tuple]:
        return [(kind, v, n, p, d, f) for p in sorted(self.held)[: self.most] for v, d, n, f in (self.held[p],)]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    for i in range(0, len(rows), 5000):
        some = zip(*rows[i : i + 5000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, types, strict=True)], names=["kind", "pattern", "n", "priority", "document", "slots"])


def fit(docs: DataFrame, text: str, key: str, labels: DataFrame | None = None, label: str = "unsafe") -> tuple[LabelModel, Linear]:
    """Both models for a corpus.

    Vote patterns are counted over every sentence.  The classifier sees bounded samples, those of least hash in the whole
    corpus however it is split, and each stands for all it was drawn from: distinct sentences with and without a vote of
    documents without judgement, and of at most LABELLED judged documents the distinct sentences of those that annotators
    call safe and whole documents that they call unsafe.  Sentences of the latter that safe documents have too are taught
    as often as those have them, whether drawn or not.  Of an unsafe document at least one sentence is: its sentences share
    the judgement by the scores of the fit so far, as far as annotators are right.
    """
    shares: dict[int, tuple[float, int]] = {}
    error = 0.1
    if labels is not None:
        told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, "annotator", label).distinct().groupBy(key).agg(F.sum(F.col(label).cast("long")).alias("_yes"), F.count(F.lit(1)).alias("_all"))
        shares = {r[0]: (r[1] / r[2], 2 * r[1] - r[2]) for r in bounded(told, LABELLED, key).collect()}
        # how often an annotator errs: two of them disagree in 2 e (1 - e) of all cases
        pairs, apart = told.agg(F.sum(F.col("_all") * (F.col("_all") - 1) / 2), F.sum(F.col("_yes") * (F.col("_all") - F.col("_yes")))).first()
        if pairs:
            error = float(np.clip((1 - np.sqrt(max(0.0, 1 - 2 * apart / pairs))) / 2, 0.01, 0.4))
    known = docs.sparkSession.sparkContext.broadcast(shares)
    src = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        texts = 0
        pools = [_Pool(n) for n in BOUNDS]
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                keys = part.column("_key").to_pylist()
                texts += len(keys)
                s = Sentences(part.column("_text"))
                share = np.array([known.value.get(k, (np.nan,))[0] for k in keys], float)
                votes, priority = s.votes(share), s.priority()
                for p, c in zip(*np.unique(votes, return_counts=True), strict=True):
                    counts[int(p)] = counts.get(int(p), 0) + int(c)
                spoken = (votes & SPOKEN) > 0
                told, owner = share[s.text], np.array([_number(k) for k in keys], np.int64)[s.text]
                # a sentence counts once in a judged document
                once, at = np.zeros(len(told), bool), np.flatnonzero(~np.isnan(told))
                at = at[np.lexsort((votes[at], priority[at], s.text[at]))]
                once[at[np.r_[True, (np.diff(priority[at]) != 0) | (np.diff(s.text[at]) != 0)]] if len(at) else at] = True
                safe = once & (told < 0.5)
                for pool, flag in zip(pools, (np.isnan(told) & spoken, np.isnan(told) & ~spoken, safe & spoken, safe & ~spoken), strict=True):
                    pool.add(s, np.flatnonzero(flag), priority, votes, owner)
                rows = [(IN_UNSAFE, int(votes[i]), 1, int(priority[i]), int(owner[i]), s.features_of(i)) for i in np.flatnonzero(once & (told >= 0.5))]
                for kind, flag in ((SAFE_VOTED_COUNT, safe & spoken), (SAFE_SILENT_COUNT, safe & ~spoken)):
                    rows += [(kind, None, int(c), int(p), None, None) for p, c in zip(*np.unique(priority[flag], return_counts=True), strict=True)]
                yield from _batches(rows)
        yield from _batches([(DOCUMENTS, None, texts, None, None, None)] + [(PATTERN, p, c, None, None, None) for p, c in counts.items()])
        for kind, pool in enumerate(pools):
            yield from _batches(pool.rows(kind))

    found = cut(src.mapInArrow(gather, GATHERED))
    of = lambda *kinds: found.where(F.col("kind").isin(*kinds))
    counts = of(PATTERN, DOCUMENTS).groupBy("kind", "pattern").agg(F.sum("n").alias("n")).toPandas()
    patterns, documents = counts[counts["kind"] == PATTERN].sort_values("pattern"), int(counts.loc[counts["kind"] == DOCUMENTS, "n"].sum())
    pattern, times = patterns["pattern"].to_numpy(np.int64), patterns["n"].to_numpy(np.int64)
    if not len(pattern):
        return None, Linear([], np.zeros(0), np.zeros(0))
    model = LabelModel(pattern, times)
    unsafe, drawn = _whole(of(IN_UNSAFE), UNSAFE_SAMPLE)
    # how many safe documents have the sentences of unsafe ones, and all others
    counted = of(SAFE_VOTED_COUNT, SAFE_SILENT_COUNT).groupBy("kind", "priority").agg(F.sum("n").alias("n"))
    counted = counted.join(of(IN_UNSAFE).select("priority").distinct().withColumn("shared", F.lit(True)), "priority", "left")
    others = {r[0]: r[1] for r in counted.where("shared is null").groupBy("kind").agg(F.sum("n")).collect()}
    shared = counted.where("shared").groupBy("priority").agg(F.sum("n").alias("n")).toArrow().sort_by("priority")
    at = shared.column("priority").to_numpy()
    mine, first = np.unique(unsafe.column("priority").to_numpy(), return_index=True)
    _, here, there = np.intersect1d(mine, at, return_indices=True)
    twins = unsafe.take(first[here]).set_column(1, "n", pa.array(shared.column("n").to_numpy()[there]))

    spoken, free = (pattern & SPOKEN) > 0, (pattern & ANNOTATED) == 0
    all_of = {VOTED: times[free & spoken].sum(), SILENT: times[free & ~spoken].sum(), SAFE_VOTED: others.get(SAFE_VOTED_COUNT, 0), SAFE_SILENT: others.get(SAFE_SILENT_COUNT, 0)}
    margin_of = {_number(k): m for k, (_, m) in shares.items()}
    rows, q, kind, weight, owner, margin = [], [], [], [], [], []
    for k, t in [*((k, _least(of(k), most)) for k, most in enumerate(BOUNDS)), (IN_UNSAFE, unsafe), (TWIN, twins)]:
        if k in (SAFE_VOTED, SAFE_SILENT):
            t = t.filter(pa.array(~np.isin(t.column("priority").to_numpy(), at)))
        if not t.num_rows:
            continue
        rows += np.split(t.column("slots").combine_chunks().flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(t.column("slots")).to_numpy())[:-1])
        q.append(model.posterior(t.column("pattern").to_numpy() & ~np.int64(ANNOTATED)))
        kind.append(np.full(t.num_rows, k))
        owner.append(t.column("document").to_numpy())
        margin.append(np.full(t.num_rows, -1) if k == TWIN else np.array([margin_of.get(d, 0) for d in owner[-1].tolist()]))
        # each sample weighs like all that it was drawn from
        n = np.ones(t.num_rows) if k in (VOTED, SILENT) else t.column("n").to_numpy().astype(float)
        n *= all_of[k] / n.sum() if k in all_of else 1 / drawn if k == IN_UNSAFE else 1.0
        weight.append(n * _voters_weight(len(shares), documents) if k in (VOTED, SILENT) else n)
    q, kind, weight, owner, margin = (np.concatenate(x) for x in (q, kind, weight, owner, margin))
    odds = lambda v: np.clip(v, 1e-5, 1 - 1e-5) / (1 - np.clip(v, 1e-5, 1 - 1e-5))
    guess, told, bag = odds(q), kind >= SAFE_VOTED, kind == IN_UNSAFE
    likely = ((1 - error) / error) ** margin.astype(float)  # how much likelier its judgements are for an unsafe document
    document = np.unique(owner[bag], return_inverse=True)[1]

    def relabel(score: np.ndarray) -> np.ndarray:
        """Of judged sentences what the words and the annotators say, of others what the words and the voters say."""
        o = np.where(told, odds(score), np.sqrt(guess * odds(score)))
        q = np.where(told, o * likely / (1 + o * likely), o / (1 + o))
        none = np.exp(-np.bincount(document, np.log1p(o[bag])))[document]  # that no sentence of the document is unsafe
        q[bag] = o[bag] / (1 + o[bag]) * likely[bag] / (likely[bag] * (1 - none) + none)
        return q

    return model, Linear(rows, np.where(told, relabel(q), q), 50 * weight / max(1.0, weight.mean()), rounds=(10, 3, 3, 3, 3, 3), decay=3e-5, relabel=relabel)


def _number(key: object) -> int:
    """A number for a document's key."""
    return key if isinstance(key, int) else int.from_bytes(hashlib.blake2b(str(key).encode(), digest_size=8).digest(), "big", signed=True)


def _voters_weight(judged: int, documents: int) -> float:
    """The weight of a sentence that only voters spoke on: 1 without judgements, that of VOTERS_WEIGH documents for the whole corpus with many."""
    return 1 / (1 + judged * documents / (VOTERS_WEIGH * max(judged, VOTERS_WEIGH)))


def _whole(rows: DataFrame, most: int) -> tuple[pa.Table, float]:
    """The sentences of whole documents, those of least hash, ``most`` or the first document's at least; and the share of all sentences that they are."""
    place = F.xxhash64("document")
    sizes = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("place")
    total = sizes["n"].cumsum()
    if len(sizes) and total.iloc[-1] > most:
        last = max(0, int((total <= most).sum()) - 1)
        rows = rows.where(place <= int(sizes["place"].iloc[last]))
        drawn = total.iloc[last] / total.iloc[-1]
    else:
        drawn = 1.0
    return rows.select("priority", "n", "pattern", "document", "slots").toArrow(), float(drawn)


def _least(rows: DataFrame, most: int) -> pa.Table:
    """The ``most`` distinct rows of least priority.  A histogram on a logarithmic scale names the cut, so that little more
    than the sample leaves the executors."""
    each = rows.groupBy("priority").agg(F.sum("n").alias("n"), F.min_by(F.struct("pattern", "document", "slots"), F.struct("pattern", "document")).alias("r"))
    step = F.floor(F.log2(F.col("priority") + F.lit(1.0)) * 128)
    counts = rows.select("priority").distinct().groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step")
    enough = counts[counts["n"].cumsum() >= most]
    if len(enough):
        each = each.where(step <= int(enough["step"].iloc[0]))
    return each.select("priority", "n", "r.pattern", "r.document", "r.slots").toArrow().sort_by("priority").slice(0, most)


def scored(docs: DataFrame, text: str, key: str, extra: list[str], linear: Linear) -> DataFrame:
    """``key``, the columns ``extra``, and ``unsafe_score`` in [0, 1]: that of the worst sentence; 0 for a null text or one without words."""
    used = np.flatnonzero(linear.w)
    model = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), linear.w[used].astype(np.float32), linear.b))
    src = docs.select(key, *extra, F.col(text).alias("_text"))
    fields = [src.schema[c] for c in (key, *extra)]
    schema = T.StructType([*fields, T.StructField("unsafe_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weight, bias = model.value
        mine = Linear.__new__(Linear)
        mine.w = np.zeros(1 << BITS, np.float32)
        mine.w[used], mine.b = weight, bias
        for batch in batches:
            for part in byte_chunks(batch, "_text"):
                s = Sentences(part.column("_text"))
                best = np.zeros(part.num_rows)
                if len(s.first):
                    np.maximum.at(best, s.text, mine.score(s))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(fields))), pa.array(best)], names=schema.names)

    return src.mapInArrow(run, schema)
