"""Names: salutations, suffixes and surname particles stay, every other word becomes a keyed pick.

A word always becomes the same word, so that a person keeps one name in all notes of one key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import Keys

# Words of names that tell nothing of a person: forms of address by walk of life, and what may follow a name.
_ADDRESS_WORDS = {
    "courtesy": "Mr Mister Mrs Ms Mx Miss Madam Mme Mlle Sir Ma'am Master",
    "learning": "Dr Doctor Prof Professor Dean Provost Chancellor",
    "church": "Rev Reverend Fr Father Pastor Rabbi Imam Bishop Deacon Cantor Sr Sister Br Brother Mother",
    "arms": "Gen General Col Colonel Maj Major Capt Captain Lt Lieutenant Sgt Sergeant Cpl Corporal Pvt Adm Admiral Cmdr Commander Officer Chief",
    "state": "Hon Honorable Judge Justice Sen Senator Rep Gov Governor Mayor Amb Ambassador Pres President",
    "rank": "Lord Lady Dame Baron Count Countess",
}
SALUTATIONS = frozenset(re.sub("[^a-z ]", "", " ".join(_ADDRESS_WORDS.values()).lower()).split())
_AFTER_NAMES = {
    "generation": "Jr Junior Sr Senior 2nd 3rd 4th 5th",
    "law": "Esq Esquire JD LLB LLM QC KC",
    "doctors": "MD DO MBBS MBChB DDS DMD DPM DVM OD DC PhD ScD DSc EdD PsyD DrPH PharmD DPT DNP FACS FACP FRCP",
    "nurses": "RN LPN LVN NP APRN ARNP FNP CRNA CNM CNS BSN MSN",
    "therapy": "PA PA-C PT OT OTR SLP RD RPh LCSW LMFT LPC LMHC MSW BSW EMT RT",
    "degrees": "BA BS BSc AB MA MS MSc MBA MPH MPA MHA MEd MFA CPA CFA PE",
}
SUFFIXES = frozenset(re.sub("[^a-z0-9 ]", "", " ".join(_AFTER_NAMES.values()).lower()).split()) | {"i" * n for n in (2, 3)} | {"iv", "v", "vi", "vii", "viii", "ix", "x"}
PARTICLES = frozenset("van von der den de del della di da dos das du la le el al bin ibn ben ter ten zu zur af av st".split())
_TOKEN = re.compile(r"[^\s,]+|[\s,]+")


def default_names() -> list[str]:
    """Invented names, by rule: a first part and an ending each."""
    starts = "Al Bar Cor Dan El Fen Gar Hol Iv Jan Kel Lor Mar Nor Or Per Quin Ros Sal Tor Ul Ver Wil Yor Zan".split()
    ends = "an ber den el ford in ley man mer nard o ric sen son ton vin wick y".split()
    return [a + b for a in starts for b in ends]


def case_of(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "lower" if word.islower() else "title"


def with_case(word: str, case: str) -> str:
    return word.upper() if case == "upper" else word.lower() if case == "lower" else "-".join(p[:1].upper() + p[1:].lower() for p in word.split("-"))


class Namer:
    def __init__(self, keys: Keys, names: Sequence[str], stopwords: Sequence[str] = ()):
        self.keys, self.names, self.stop = keys, list(names), frozenset(s.lower() for s in stopwords)

    def index(self, text: str, n: int) -> int:
        return int.from_bytes(hashlib.sha256(self.keys.both + text.encode()).digest()[:8]) % n

    def spurious(self, text: str) -> bool:
        t = text.strip()
        return len(t) <= 1 or not any(c.isalpha() for c in t) or t.lower() in self.stop

    def word(self, token: str) -> str:
        bare = token.strip(".'’()").lower()
        possessive = next((s for s in ("'s", "’s") if token.lower().endswith(s)), "")
        bare = bare.removesuffix("'s").removesuffix("’s")
        if not bare or not any(c.isalpha() for c in bare):
            return token
        if len(bare) == 1:  # an initial
            letter = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[self.index(bare, 26)]
            return token.replace(next(c for c in token if c.isalpha()), letter if token[0].isupper() else letter.lower(), 1)
        body = token.removesuffix(possessive) if possessive else token
        parts = body.split("-")
        new = "-".join(with_case(self.names[self.index(p.strip(".()").lower(), len(self.names))], case_of(p)) for p in parts if p)
        return new + possessive

    def replace(self, text: str | None) -> str | None:
        if text is None or self.spurious(text):
            return text
        tokens = _TOKEN.findall(text)
        words = [i for i, t in enumerate(tokens) if t[0] not in " \t\n\r\x0b\x0c,"]
        plain = {i: re.sub(r"[^a-z0-9]", "", tokens[i].lower()) for i in words}
        keep: set[int] = set()
        for i in words:  # salutations stand first
            if plain[i] not in SALUTATIONS or len(words) - len(keep) == 1:
                break
            keep.add(i)
        for i in reversed(words):  # suffixes last
            if i in keep or plain[i] not in SUFFIXES or len(words) - len(keep) == 1:
                break
            keep.add(i)
        rest = [i for i in words if i not in keep]
        keep |= {i for i in rest[:-1] if plain[i] in PARTICLES}  # a particle stands before a surname
        return "".join(t if i in keep or i not in plain else self.word(t) for i, t in enumerate(tokens))


def replace_names(text: Column, keys: Keys, names: Sequence[str] | None = None, stopwords: Sequence[str] = ()) -> Column:
    namer = Namer(keys, names or default_names(), stopwords)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(namer.replace)

    return run(text)
