"""Questions to search terms.  A question is short, so this runs where the plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words that say nothing of a question's subject, words of asking, and other forms of words; fixed values.
STOP = frozenset("и в во не на что как по для при это из кто который от до все также или ли бы же уже при том что бы там тут где когда если то есть при".split())
ASKING = frozenset(
    "какие какой какая какое каким каких какую каков какова каковы существует существуют существующий существующие имеется имеются имеет имеют перечислите назовите укажите опишите расскажите сообщите".split()
)
FORMS = {
    "бизне": ["бизнес", "бизнеса", "бизнесу", "бизнес-план", "бизнес план"],
    "безнес": ["бизнес", "бизнес-план"],
    "планн": ["план"],
    "приказ": ["приказа", "приказе"],
    "положен": ["положение", "положения", "положении"],
    "закуп": ["закупка", "закупки", "закупок", "закупке", "закупках", "закупочная"],
    "закупк": ["закупка", "закупки", "закупок"],
    "договор": ["договора", "договору", "договором", "договоры"],
    "поставщик": ["поставщика", "поставщиком", "поставщики"],
    "контракт": ["контракта", "контракту", "контракты"],
    "стать": ["статья", "статьи", "статье", "статью"],
    "пункт": ["пункта", "пункте", "пункты"],
    "срок": ["срока", "сроки", "сроков"],
    "заявок": ["заявки", "заявку", "заявка", "подачи", "подачу", "подач"],
    "аукцион": ["аукциона", "аукционе", "аукциону", "аукционов"],
    "календар": ["календарных", "календарные", "календарного"],
    "ответствен": ["ответственность", "ответственности"],
    "прем": ["премия", "премии", "премий", "премирование", "премирования", "премированию"],
    "премий": ["премия", "премии", "прем", "премирование"],
    "премии": ["премия", "премий", "прем", "премирование"],
    "премия": ["премии", "премий", "прем", "премирование"],
    "вид": ["виды", "вида", "видов", "виду"],
    "виды": ["вид", "вида", "видов"],
}
SPAN = 180
FUZZY = 0.78


def words(s: str) -> list[str]:
    return re.findall(r"\w+", s.lower())


def matchable(s: str) -> str:
    return re.sub(r"[\s\-–—]+", " ", s.lower().replace("\u00ad", "").replace("\u2010", "-")).strip()


def stem(w: str) -> str:
    n = len(w)
    return w[: 9 if n >= 10 else 7 if n >= 7 else 5] if n >= 5 else w


def distinct(items) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))


@dataclass(frozen=True)
class Question:
    text: str
    words: tuple[str, ...]
    core: tuple[str, ...]
    content: tuple[str, ...]

    @staticmethod
    def of(text: str) -> Question:
        found = words(text)
        known = [w for w in found if len(w) > 1 and w not in STOP | ASKING]
        core = [w for w in known if len(w) > 2] or known
        content = [w for w in core if w not in ASKING] or core
        return Question(text, tuple(found), tuple(core), tuple(content))

    @property
    def need(self) -> int:
        """Core words that a hit has to match."""
        n = len(self.content or self.core)
        return n if n < 2 else 2 if n < 4 else max(2, (2 * n + 2) // 3)

    @property
    def enriched(self) -> str:
        q, extra = self.text.strip(), " ".join(self.core)
        return f"{q}. Ключевые термины: {extra}. {extra}" if extra else q

    def tokens(self) -> list[str]:
        """All forms to look for, the longest first, then in order of the alphabet."""
        out: set[str] = set(self.core)
        for w in (w for w in self.words if len(w) > 1):
            forms = FORMS.get(w, [])
            out |= {w, *forms, *(p for f in forms for p in words(f))}
        for w in self.core:
            out |= set(FORMS.get(w, []))
        out |= {x for w in (*self.words, *self.core) if len(w) > 3 for x in (stem(w),)} | {w[:4] for w in self.words if len(w) > 3}
        if len(self.words) > 1:
            out |= {sep.join(self.words) for sep in ("-", " ", "")}
        return sorted(out, key=lambda x: (-len(x), x))

    def phrases(self) -> list[str]:
        """Wordings for a search by meaning."""
        low = matchable(self.text)
        kept = [w for w in low.split() if len(w) > 1 and w not in STOP]
        runs = [" ".join(kept[i : i + n]) for n in (2, 3) for i in range(len(kept) - n + 1)]
        whole = [low, low.replace("бизне", "бизнес"), low.replace(" ", "-"), low.replace(" ", ""), " ".join(self.core), "-".join(self.core)]
        single = [x for w in self.core if len(w) > 3 for x in (w, stem(w))]
        return [self.text.strip(), self.enriched, *distinct([*whole, *runs, *single, *self.kinds(("виды", "вид"))])]

    def kinds(self, triggers: tuple[str, ...]) -> list[str]:
        """«виды X» for questions about kinds."""
        if not set(triggers) & set(self.core):
            return []
        return [f"виды {x}" for w in self.content if w not in triggers for x in (w, stem(w))]

    def substrings(self) -> list[str]:
        """Wordings of at least eight characters to look for as they are, the longest first."""
        w, core, content = self.words, self.core, self.content
        found = [self.text, *(" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 2, min(i + 10, len(w) + 1)))]
        if len(core) > 1:
            found += [" ".join(x) for x in (core, content, core[-2:], core[-3:])]
        found += self.kinds(("виды",))
        if len(core) > 3:
            found += [f"{core[0]} {core[1]} для {core[2]} {core[3]}", f"{core[1]} для {' '.join(core[2:])}"]
        return sorted((s for s in distinct(map(matchable, found)) if len(s) > 7), key=lambda s: -len(s))

    def stems(self) -> list[str]:
        """Stems of at least six characters, and the last two together."""
        pair = " ".join(map(stem, self.core[-2:])) if len(self.core) > 1 else ""
        return distinct([*(s for s in map(stem, self.core) if len(s) > 5), pair if len(pair.replace(" ", "")) > 9 else ""])
