"""Japanese names in Hangul: kana by sound, known words by a dictionary, all else as it is."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
#: Fixed values of the transcription: consonants by their Latin letters, at a word's start and elsewhere where that differs.
AT_START = {"": "ㅇ", "K": "ㄱ", "G": "ㄱ", "S": "ㅅ", "Z": "ㅈ", "T": "ㄷ", "D": "ㄷ", "N": "ㄴ", "H": "ㅎ", "B": "ㅂ", "P": "ㅍ", "M": "ㅁ", "Y": "ㅇ", "R": "ㄹ", "W": "ㅇ", "V": "ㅂ"}
ELSEWHERE = {"K": "ㅋ", "T": "ㅌ", "CH": "ㅊ"}
#: Kana whose sound isn't what their row says: (consonant class, Latin vowel).
SOUNDS = {"TI": ("CH", "I"), "DI": ("Z", "I"), "TU": ("TS", "EU"), "DU": ("Z", "EU"), "SU": ("S", "EU"), "ZU": ("Z", "EU"), "WO": ("", "O"), "WA": ("", "WA")}
CLASSES = {"CH": "ㅈ", "TS": "ㅆ"}
VOWELS = {"A": "ㅏ", "I": "ㅣ", "U": "ㅜ", "E": "ㅔ", "O": "ㅗ", "YA": "ㅑ", "YU": "ㅠ", "YO": "ㅛ", "WA": "ㅘ", "WI": "ㅟ", "WE": "ㅞ", "WO": "ㅝ", "YE": "ㅖ", "EU": "ㅡ"}
LONG = {"う": {"O", "U", "YO", "YU"}, "お": {"O", "YO"}}
FINALS = {"ん": "ㄴ", "っ": "ㅅ"}
MORA = re.compile(r"(?P<kana>[ぁ-ゖ])(?P<small>[ゃゅょぁぃぅぇぉ]?)|(?P<other>.)", re.DOTALL)


def _letters(kana: str) -> str:
    """The Latin letters of a kana, as its Unicode name has them (`KA`, `SMALL YA`)."""
    return unicodedata.name(kana, "").removeprefix("HIRAGANA LETTER ")


def _sound(kana: str, small: str) -> tuple[str, str] | None:
    """(consonant class, vowel) of a mora; null when it is none."""
    letters = _letters(kana)
    if letters.startswith("SMALL") or not letters.isalpha() or letters[-1] not in "AIUEO":
        return None
    consonant, vowel = SOUNDS.get(letters, (letters[:-1], letters[-1]))
    if consonant == "Y":
        consonant, vowel = "", "Y" + vowel
    if not small:
        return consonant, vowel
    glide = _letters(small).removeprefix("SMALL ")
    if glide[0] == "Y":
        soft = letters in ("ZI", "DI", "TI")  # ja, cha: the glide is in the consonant
        return consonant, glide[1:] if soft else glide
    if letters == "HU":
        return "P", glide
    return consonant, {("U", "I"): "WI", ("U", "E"): "WE", ("U", "O"): "WO", ("SI", "E"): "YE"}.get((letters, glide), glide)


def _joined(lead: str, vowel: str) -> str:
    """A syllable block from jamo, composed by Unicode's own rules."""
    first = unicodedata.lookup("HANGUL CHOSEONG " + unicodedata.name(lead).removeprefix("HANGUL LETTER "))
    middle = unicodedata.lookup("HANGUL JUNGSEONG " + unicodedata.name(vowel).removeprefix("HANGUL LETTER "))
    return unicodedata.normalize("NFC", first + middle)


def _closed(out: list[str], final: str) -> list[str]:
    """The text so far with a final consonant under its last syllable, or after it where that has one or is none."""
    under = unicodedata.lookup("HANGUL JONGSEONG " + unicodedata.name(final).removeprefix("HANGUL LETTER "))
    whole = unicodedata.normalize("NFC", out[-1] + under) if out else ""
    return [*out[:-1], whole] if len(whole) == 1 else [*out, final]


def hangul_of(kana: str, loan: bool = False) -> str:
    """A reading in hiragana as Hangul; `loan`: aspirated consonants at the start too."""
    out: list[str] = []
    vowel = ""  # of the last mora: a vowel letter that lengthens it isn't written
    for m in MORA.finditer(kana):
        c = m["kana"] or m["other"]
        if c in FINALS and not m["small"]:
            out = _closed(out, FINALS[c]) if c == "ん" or m.end() < len(kana) else out
        elif c == "ー" or (vowel in LONG.get(c, ()) and not m["small"]):
            continue
        elif m["kana"] and (sound := _sound(c, m["small"])):
            consonant, vowel = sound
            start = CLASSES.get(consonant) or AT_START[consonant]
            out.append(_joined(ELSEWHERE.get(consonant, start) if out or loan else start, VOWELS[vowel]))
        else:
            out.append(m[0])
            vowel = ""
    return "".join(out)


def to_hiragana(s: str) -> str:
    return s.translate(str.maketrans(KATAKANA, HIRAGANA))


def hiragana(s: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(s, KATAKANA, HIRAGANA)


def transliterate(words: dict[str, str], *, branch: tuple[str, str] = ("店", "점"), not_branch: tuple[str, ...] = ("本店", "支店", "商店"), joined: tuple[str, ...] = ("역", "성", "신사", "점")):
    """A function of names: known words as given (longest first), kana by sound, all else as it is.

    A branch ending is set off from the name and given as the second of `branch`; words of `joined` lose the
    space before them. Names without Japanese letters stay. Readings of kanji need a dictionary that
    isn't part of this package: such runs stay. Apply it to distinct names and join back.
    """
    known = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    part = re.compile((f"(?P<word>{known})|" if known else "(?P<word>(?!))|") + r"(?P<kana>[ぁ-ゖァ-ヺー]+)|(?P<other>.)", re.DOTALL)
    japanese = re.compile("[\u3040-\u30ff\u4e00-\u9fff]")
    tight = re.compile(f" ({'|'.join(map(re.escape, joined))})(?= |$)") if joined else None

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        s, tail = unicodedata.normalize("NFKC", name).strip(), ""
        if not japanese.search(s):
            return s
        if branch and s.endswith(branch[0]) and not s.endswith(not_branch):
            s, tail = s[: -len(branch[0])], branch[1]
        out = []
        for m in part.finditer(s):
            if m["word"]:
                out.append(f" {words[m['word']]} ")
            elif m["kana"]:
                out.append(hangul_of(to_hiragana(m["kana"]), not re.search("[ぁ-ゖ]", m["kana"])))
            else:
                out.append(" " if m["other"] == "・" else m["other"])
        whole = " ".join("".join(out).split()) + tail
        return tight.sub(r"\1", whole) if tight else whole

    @F.pandas_udf(StringType())
    def names(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(one)

    return names
