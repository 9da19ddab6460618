"""Natural-language conditions to predicate atoms: normalising, slotting of entity names, ordered rules, compounds."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.cluster import ship

from .numeric import NUMBER_WORDS

#: Contractions and the second person, as written out, verbs of the third person, words that add nothing, and words that name no entity.
CONTRACTIONS = {"doesn't": "does not", "don't": "do not", "didn't": "did not", "hasn't": "has not", "haven't": "have not", "isn't": "is not", "aren't": "are not", "won't": "will not", "can't": "cannot"}
AGREEMENT = {"do": "does", "have": "has", "are": "is"}
PERSON = {"you're": "the player is", "you've": "the player has", "your": "the player's", "you": "the player"}
FILLERS = "still already now yet previously once just ever also finally then currently".split()
NO_ENTITY = {"the player", "player character"} | set("""
player you me we they them he she it us myself yourself themselves i
below while above after before between beyond within under until since about next another this that with from your
have will what been were said each make like just over such take than some well also back then good look come could made find here know want
give most only tell very when much need long time help left right home keep last name turn move live work read lost part talk sure down gone done rest
""".split())
LEAST_NAME = 4
_TYPED_LINK = re.compile(r"\[[^\]]+\]\((item|quest|npc|monster|location|equipment|shop|activity):(?:[^()]+|\([^)]*\))*\)")

NEGATION = r"(?P<neg>(?:does|do|is|are|has|have|did) not )?"
NUMBER = r"(?P<count>\d[\d,]*|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
THING = r"(?P<item>\{(?:item|equipment)\}|(?:(?! and | but )[a-z' -])+?)"
POSSESS = r"(?:have|has|own|owns|carry|carries|carrying|holding|hold|holds|bring|brings)"


@dataclass(frozen=True)
class Rule:
    """A frame's name and pattern; its named groups become the arguments. Raw rules see the text with its subject."""

    frame: str
    pattern: str
    raw: bool = False


#: In order: the first that matches decides.
RULES = [
    Rule("quest_state", r"(?:if |when )?\{quest\} (?:is |has been |was )?(?P<state>not started|not completed|completed|complete|started|in progress)$", raw=True),
    Rule("quest_state", rf"{NEGATION}(?:has |have )?(?P<state>completed|complete|started|finished|start|finish) (?P<quest>\{{quest\}}|the quest)"),
    Rule("quest_decision", r"(?:chose|chooses|decided|decides) to (?P<choice>.+?) (?:during|in) (?P<quest>\{quest\}|the quest)$"),
    Rule("diary_completed", rf"{NEGATION}(?:has |have )?completed (?:the )?(?P<tier>easy|medium|hard|elite)? ?(?P<place>[a-z ]+) diary"),
    Rule("skill_ge", rf"{NEGATION}(?:has |have )?(?:at least )?(?:level )?(?P<level>\d+)\+?(?: or (?:higher|more))? (?P<skill>\{{skill\}}|[a-z]+)(?: level)?$"),
    Rule("skill_ge", r"(?P<skill>\{skill\}) level is (?:at least )?(?P<level>\d+)"),
    Rule("monster_skill_check", rf"{NEGATION}{POSSESS} (?:the )?required (?P<skill>\{{skill\}}|slayer) level"),
    Rule("combat_level", r"combat level (?:is )?(?:at least )?(?P<level>\d+)"),
    Rule("wearing_either", rf"{NEGATION}(?:is |are )?(?:wearing|wears|equipped) (?:an? |the )?(?P<item>\S+) or (?:an? |the )?(?P<other>\S+)$"),
    Rule("wearing", rf"{NEGATION}(?:is |are |has |have )?(?:wearing|wears|wear|equipped) (?:an? |the |any )?{THING}$"),
    Rule("has_coins", rf"{NEGATION}{POSSESS} (?:at least |enough )?(?P<count>\d[\d,]*)? ?(?:coins|gp)"),
    Rule("currency_cap", r"(?:would (?:have|exceed)|has reached|is at) (?:more than )?(?:the )?(?:maximum|max|limit|cap)(?: of)? ?(?P<currency>\{currency\}|coins)?"),
    Rule("has_currency", rf"{NEGATION}{POSSESS} (?:at least |enough )?(?P<count>\d[\d,]*)? ?(?P<currency>\{{currency\}})"),
    Rule("has_all_items", rf"{NEGATION}{POSSESS} (?:all|both) (?:of )?(?:the )?{THING}$"),
    Rule("inventory_space", rf"{NEGATION}{POSSESS} (?:at least )?(?:{NUMBER} )?(?:free |empty |enough )(?:inventory )?(?:space|slot)s?"),
    Rule("inventory_space", r"(?:the player's |their )?inventory is (?P<state>full|not full)"),
    Rule("showing_item", rf"{NEGATION}show(?:s|ing|n)? (?:the |an? )?{THING}$"),
    Rule("has_read", rf"{NEGATION}(?:has |have )?read (?:the )?(?P<item>.+)$"),
    Rule("received_reward", rf"{NEGATION}(?:has |have )?(?:received|claimed|collected|been given) (?:the |their |an? )?(?P<item>.+)$"),
    Rule("reward_is", r"(?:the )?reward is (?:an? |the )?(?P<item>.+)$"),
    Rule("patch_planted", rf"{NEGATION}(?:has |have )?planted (?:an? |the )?(?P<crop>.+)$"),
    Rule("patch_grown", r"(?:the |their )?(?P<crop>crop|tree|plant|\{item\})s? (?:has|have|is|are) (?P<state>fully grown|grown|growing|dead|diseased)"),
    Rule("patch_state", r"(?:the )?patch is (?P<state>[a-z ]+)$"),
    Rule("port_task", rf"{NEGATION}{POSSESS} (?:an? |the )?(?:active )?port task"),
    Rule("has_rumour", rf"{NEGATION}{POSSESS} (?:an? |the )?(?:active )?rumour"),
    Rule("task_progress", r"(?:has |have )?(?P<done>killed|caught|delivered|gathered) (?P<count>all|some|none|\d+)"),
    Rule("all_completed", rf"{NEGATION}(?:has |have )?completed all (?:of )?(?:the )?(?P<what>.+)$"),
    Rule("has_assignment", rf"{NEGATION}{POSSESS} (?:an? |the )?(?:slayer )?(?:task|assignment)"),
    Rule("password_check", r"(?:enters|entered|gives|gave) the (?P<verdict>correct|right|wrong|incorrect) password"),
    Rule("puzzle_solved", rf"{NEGATION}(?:has |have )?(?:solved|completed) (?:the )?(?P<puzzle>.*puzzle.*)$"),
    Rule("puzzle_answer", r"(?:the )?(?:solution|puzzle's answer) is (?P<answer>.+)$"),
    Rule("answered_item", r"(?:answers?|answered) with (?:an? |the )?(?P<item>\{item\})$"),
    Rule("dialogue_input", r"(?:enters|entered|types|typed) (?P<value>.+)$"),
    Rule("answered", r"(?:answers?|answered|says?|said|replies|replied) (?P<answer>.+)$"),
    Rule("has_talked_to", rf"{NEGATION}(?:has |have )?(?:talked|talks|spoken|spoke|speaks|talk) (?:to|with) (?P<npc>.+)$"),
    Rule("talking_to", r"(?:is |are )?(?:talking|speaking) (?:to|with) (?P<npc>.+)$"),
    Rule("npc_thought", r"(?:the )?(?P<npc>\{npc\}|\S+) (?:thinks|believes) (?P<thought>.+)$"),
    Rule("npc_role", r"(?:the )?(?P<npc>\{npc\}) is (?:an? |the )?(?P<role>[a-z ]+)$"),
    Rule("npc_at_location", r"(?:the )?(?P<npc>\{npc\}) is (?:in|at|near) (?P<place>.+)$"),
    Rule("proximity_check", r"(?:is |are )?(?P<verdict>too far|close enough|within \d+ tiles)(?: (?:from|to|of) (?P<place>.+))?$"),
    Rule("dialogue_state", r"(?:the )?(?:conversation|dialogue|chat) (?:is |was |has )?(?P<state>continued|repeated|ended|interrupted)"),
    Rule("time_out", r"(?:takes too long|time runs out|timer (?:runs out|expires))"),
    Rule("location_at", rf"{NEGATION}(?:is |are )?(?:in|at|inside|near) (?P<place>\{{location\}}|[a-z' ]+)$"),
    Rule("member_only", rf"{NEGATION}(?:is |are )?(?:on )?(?:an? )?members?(?: world)?$"),
    Rule("ironman_ultimate", rf"{NEGATION}(?:is |are )?(?:an? )?ultimate iron ?man"),
    Rule("account_state", r"(?:account|bank pin) (?:is|has been) (?P<state>[a-z ]+)$"),
    Rule("world_type", r"(?:is |are )?on an? (?P<kind>[a-z]+) world$"),
    Rule("world_state", r"(?:the |an? )?(?P<thing>door|gate|lever|portal|boat|bridge|chest) is (?P<state>[a-z ]+)$"),
    Rule("ironman", rf"{NEGATION}(?:is |are )?(?:an? )?(?P<kind>ultimate |hardcore )?iron ?man"),
    Rule("gender", rf"{NEGATION}(?:is |are )?(?P<gender>male|female)$"),
    Rule("has_follower", rf"{NEGATION}{POSSESS} (?:an? |the )?(?:pet|follower|cat)"),
    Rule("owns", rf"{NEGATION}(?:already )?owns? (?:an? |the )?(?P<thing>house|ship|boat|cat|kingdom)$"),
    Rule("has_chosen", rf"{NEGATION}(?:has |have )?(?:chosen|selected|picked) (?P<choice>.+)$"),
    Rule("needs_to_build", rf"{NEGATION}(?:needs?|has) to (?:build|repair|construct) (?:an? |the )?(?P<thing>.+)$"),
    Rule("cast_count", r"(?:has |have )?cast (?:the )?(?P<spell>.+?) (?P<count>\d+) times?$"),
    Rule("in_combat", rf"{NEGATION}(?:is |are )?in combat"),
    Rule("has_event_action", rf"{NEGATION}(?:has|have) (?P<action>[a-z]+ed)(?: (?P<object>.+))?$"),
    Rule("has_item", rf"{NEGATION}{POSSESS} (?:{NUMBER} )?(?:of )?{THING}(?: in (?:their |the player's |the )?(?P<where>inventory|bank|possession))?$"),
    Rule("outcome", r"(?P<outcome>succeeds?|fails?|wins?|loses?|dies|succeeded|failed|won|lost|died)(?: .*)?$"),
    Rule("event_past_tense", r"(?P<action>[a-z]+ed) (?:the |an? )?(?P<object>.+)$"),
    Rule("meta_predicate", r"(?:any|one|both|all|none) of the (?:above|following)"),
    Rule("non_predicate", r"(?:see|note|continues?|same as) .*$"),
    Rule("event", r"(?P<event>first time|second time|subsequent|afterwards|otherwise|later).*$"),
]
_COMPILED = [(r, re.compile(r.pattern)) for r in RULES]
_SUBJECT = re.compile(r"^(?:if |when |while |unless )?(?:the player(?:'s)? |player |they |he |she )?")
_SECOND_PERSON = re.compile(rf"\b(you\s+)({'|'.join(AGREEMENT)})(?=\s+not\b)")
_FILLER = re.compile(rf"\b(?:{'|'.join(FILLERS)}) ")
_SPLIT = re.compile(r" (?:and|but) (?!more\b|\d)|, (?:and |but )?(?=(?:has|have|is|are|does|do|did)\b)")


def slotted(text: str, names: dict[str, str]) -> str:
    """Known names, longest and leftmost first and as whole words, give way to their type in braces."""
    if not names:
        return text
    pattern = r"(?<![a-z0-9])(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?![a-z0-9])"
    return re.sub(pattern, lambda m: "{" + names[m[0]] + "}", text)


def normalise(text: str, names: dict[str, str], currencies: tuple[str, ...] = (), skills: tuple[str, ...] = (), agree: bool = False) -> str:
    """Lower case, typed links, currencies, entity names and skills as slots, short forms written out, no closing marks.
    agree: where "you" becomes the player, the negated verb after it goes with the third person ("you don't": "the player does
    not"); atoms keep the verb as it was said."""
    t = _TYPED_LINK.sub(lambda m: "{" + m[1] + "}", text)
    t = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", t).lower().replace("’", "'")
    for short, long in CONTRACTIONS.items():
        t = re.sub(rf"\b{re.escape(short)}\b", long, t)
    if agree:
        t = _SECOND_PERSON.sub(lambda m: m[1] + AGREEMENT[m[2]], t)
    for short, long in PERSON.items():
        t = re.sub(rf"\b{re.escape(short)}\b", long, t)
    known = {n: k for n, k in names.items() if len(n) >= LEAST_NAME and n not in NO_ENTITY}
    for table in (dict.fromkeys(currencies, "currency"), known, dict.fromkeys(skills, "skill")):
        t = slotted(t, table)
    return re.sub(r"\s+", " ", re.sub(r"[.,:;!?]+$", "", t.strip())).strip()


def atom(text: str) -> tuple[str, dict[str, str]] | None:
    """Frame and arguments of a single condition."""
    plain = _FILLER.sub("", text)
    body = _SUBJECT.sub("", plain)
    for rule, pattern in _COMPILED:
        m = pattern.match(plain if rule.raw else body)
        if m:
            return rule.frame, {k: v.strip() for k, v in sorted(m.groupdict().items()) if v}
    return None


def atoms(text: str, unknown: bool = False) -> list[tuple[str, dict[str, str]]]:
    """A whole condition if it's one, else those of its clauses that are; clauses inherit the first one's subject."""
    whole = atom(text)
    if whole:
        return [whole]
    parts = [p.strip() for p in _SPLIT.split(text) if p and p.strip()]
    found = [a for a in map(atom, parts) if a] if len(parts) > 1 else []
    return found or ([("unknown", {"text": _SUBJECT.sub("", text)})] if unknown else [])


def parse_conditions(df: DataFrame, key: str, text: str, names: dict[str, str], unknown: bool = True, currencies: tuple[str, ...] = (), skills: tuple[str, ...] = ()) -> DataFrame:
    """(key, frame, args) of each atom. names: lower-cased entity names to types, of a vocabulary's size."""

    def by_batch(batches):
        for batch in batches:
            out = [(k, f, a) for k, t in zip(batch[key], batch[text]) for f, a in atoms(normalise(t or "", names, currencies, skills), unknown)]
            yield pd.DataFrame(out, columns=[key, "frame", "args"])

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long"), text).mapInPandas(by_batch, f"{key} long, frame string, args map<string,string>")


def normalised(df: DataFrame, key: str, text: str, names: dict[str, str]) -> DataFrame:
    """(key, text) with the text in normal form, verbs agreeing with the player; null for none. Keys pass as they are."""

    def by_batch(batches):
        for batch in batches:
            said = [None if t is None else normalise(t, names, agree=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=[key, text])

    ship(df.sparkSession)
    return df.select(F.col(key).cast("long"), text).mapInArrow(by_batch, f"{key} long, {text} string")
