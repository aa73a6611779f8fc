"""Policies: which action each entity or path gets. First rule in file order wins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from fnmatch import fnmatch
from pathlib import Path
from typing import Any

from cloakstone.operators.column_names import ENTITIES as NAMED
from cloakstone.operators.detectors import DETECTORS

from .paths import PathError, Step, parse_path

#: By rising severity.
ACTIONS = ("allow", "partial_mask", "mask", "tokenize", "redact", "block")
SEVERITY = {a: i for i, a in enumerate(ACTIONS)}
KNOWN_ENTITIES = frozenset(d.entity_type for d in DETECTORS) | NAMED | {"UPI_ID"}


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Match:
    json_path: str
    tool: str = "*"
    steps: tuple[Step, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    action: str
    entities: tuple[str, ...] = ()
    match: Match | None = None
    scope: str = "field"
    message: str | None = None


@dataclass(frozen=True)
class Defaults:
    unknown_entity_action: str = "mask"
    min_confidence: float = 0.4
    ner: bool | str = "auto"


@dataclass(frozen=True)
class Policy:
    name: str
    version: int = 1
    defaults: Defaults = Defaults()
    rules: tuple[Rule, ...] = ()

    def resolve(self, entity: str) -> tuple[str, Rule | None]:
        """The action for an entity, and the rule that says so."""
        rule = next((r for r in self.rules if entity in r.entities), None)
        return (rule.action, rule) if rule else (self.defaults.unknown_entity_action, None)

    def path_rules(self, tool: object) -> list[Rule]:
        """Rules with a path that hold for a tool, in order; all of them where the tool isn't a name but differs by row."""
        return [r for r in self.rules if r.match and (not isinstance(tool, str) or fnmatch(tool, r.match.tool))]

    def covered(self) -> frozenset[str] | None:
        """The only entities worth looking for; None: all, since what no rule names isn't allowed either."""
        if self.defaults.unknown_entity_action != "allow":
            return None
        return frozenset(e for r in self.rules for e in r.entities)


def _known_keys(kind: type, data: Any, where: str, hidden: tuple[str, ...] = ()) -> dict:
    if not isinstance(data, dict):
        raise PolicyError(f"{where}: expected a mapping")
    if extra := sorted(map(str, set(data) - {f.name for f in fields(kind)} | set(data) & set(hidden))):
        raise PolicyError(f"{where}: unknown keys {extra}")
    return data


def _action(value: Any, where: str) -> str:
    if value not in ACTIONS:
        raise PolicyError(f"{where}: action must be one of {list(ACTIONS)}, not {value!r}")
    return value


def _rule(data: Any, where: str, known: frozenset[str]) -> Rule:
    data = _known_keys(Rule, data, where)
    if not isinstance(data.get("id"), str):
        raise PolicyError(f"{where}: a rule needs an id")
    where = f"rule {data['id']!r}"
    entities, match = data.get("entities") or [], data.get("match")
    if not isinstance(entities, list | tuple) or not all(isinstance(e, str) for e in entities):
        raise PolicyError(f"{where}: entities must be a list of names")
    if not entities and match is None:
        raise PolicyError(f"{where} must have entities or match")
    if unknown := sorted(set(entities) - known):
        raise PolicyError(f"{where} names unknown entities {unknown}; known: {sorted(known)}")
    action, scope = _action(data.get("action"), where), data.get("scope", "field")
    if scope not in ("field", "result"):
        raise PolicyError(f"{where}: scope must be field or result")
    if scope == "result" and action != "block":
        raise PolicyError(f"{where}: scope result goes with action block only")
    made = None
    if match is not None:
        match = _known_keys(Match, match, f"{where}, match", ("steps",))
        try:
            made = Match(match["json_path"], match.get("tool", "*"), parse_path(match["json_path"]))
        except KeyError:
            raise PolicyError(f"{where}: match needs json_path") from None
        except PathError as e:
            raise PolicyError(f"{where}: {e}") from None
    return Rule(data["id"], action, tuple(entities), made, scope, data.get("message"))


def parse_policy(data: Any, extra_entities: Iterable[str] = ()) -> Policy:
    """A policy from plain data; a sole top-level key ``policy`` is looked through."""
    if isinstance(data, dict) and set(data) == {"policy"}:
        data = data["policy"]
    data = _known_keys(Policy, data, "policy")
    if not isinstance(data.get("name"), str):
        raise PolicyError("policy: a name is needed")
    d = _known_keys(Defaults, data.get("defaults") or {}, "defaults")
    ner = d.get("ner", "auto")
    if ner not in (True, False, "auto"):
        raise PolicyError("defaults: ner must be true, false or auto")
    try:
        least = float(d.get("min_confidence", 0.4))
    except (TypeError, ValueError):
        raise PolicyError("defaults: min_confidence must be a number") from None
    defaults = Defaults(_action(d.get("unknown_entity_action", "mask"), "defaults"), least, ner)
    known = KNOWN_ENTITIES | frozenset(extra_entities)
    rules = tuple(_rule(r, f"rules[{i}]", known) for i, r in enumerate(data.get("rules") or []))
    ids = [r.id for r in rules]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise PolicyError(f"policy: duplicate rule ids {twice}")
    return Policy(data["name"], data.get("version", 1), defaults, rules)


def load_policy(path: str | Path, extra_entities: Iterable[str] = ()) -> Policy:
    import yaml

    return parse_policy(yaml.safe_load(Path(path).read_text(encoding="utf-8")), extra_entities)


SECRETS = ["AWS_ACCESS_KEY", "GITHUB_TOKEN", "JWT"]
WITHHELD = "The result contained a credential and was withheld entirely."


def _pack(name: str, default: str, least: float, *rules: tuple) -> dict:
    """rules: (id, entities, action[, message[, scope]])."""
    keys = ("id", "entities", "action", "message", "scope")
    return {"name": name, "defaults": {"unknown_entity_action": default, "min_confidence": least}, "rules": [dict(zip(keys, r, strict=False)) for r in rules]}


def _law(name: str) -> dict:
    pack = name.upper()
    return _pack(
        name, "mask", 0.4,
        ("secrets-block", SECRETS, "block", "This field contained a credential and was blocked by policy."),
        ("govt-id-block", ["AADHAAR", "PAN", "GOVT_ID"], "block", f"This field contained a government identifier and was blocked by the {pack} policy pack."),
        ("financial-block", ["CREDIT_CARD", "BANK_ACCOUNT"], "block", f"This field contained a financial identifier and was blocked by the {pack} policy pack."),
        ("names-mask", ["PERSON_NAME"], "mask"), ("contact-mask", ["EMAIL", "PHONE"], "mask"), ("location-dob-redact", ["ADDRESS", "DOB"], "redact"),
        ("ip-mask", ["IP_ADDRESS"], "mask"), ("ifsc-allow", ["IFSC"], "allow"),
    )


#: What the presets do with each entity.
PRESETS: dict[str, dict] = {
    "personal": _pack(
        "personal", "allow", 0.4,
        ("secrets-block", SECRETS, "block"), ("govt-financial-block", ["AADHAAR", "PAN", "GOVT_ID", "CREDIT_CARD", "BANK_ACCOUNT"], "block"),
        ("contact-partial", ["EMAIL", "PHONE"], "partial_mask"), ("infra-allow", ["IP_ADDRESS", "IFSC"], "allow"),
    ),
    "ngo-default": _pack(
        "ngo-default", "mask", 0.4,
        ("secrets-block", SECRETS, "block", "This field contained a credential and was blocked by policy."),
        ("govt-financial-block", ["AADHAAR", "PAN", "GOVT_ID", "CREDIT_CARD", "BANK_ACCOUNT"], "block", "This field contained a government or financial identifier and was blocked by your organization's policy."),
        ("contact-partial", ["EMAIL", "PHONE"], "partial_mask"), ("names-mask", ["PERSON_NAME"], "mask"), ("location-redact", ["ADDRESS", "DOB"], "redact"), ("infra-allow", ["IP_ADDRESS", "IFSC"], "allow"),
    ),
    "strict": _pack(
        "strict", "block", 0.3,
        ("secrets-kill", SECRETS, "block", WITHHELD, "result"),
        ("pii-block", ["EMAIL", "PHONE", "AADHAAR", "PAN", "IFSC", "CREDIT_CARD", "GOVT_ID", "PERSON_NAME", "ADDRESS", "BANK_ACCOUNT", "DOB", "IP_ADDRESS"], "block"),
    ),
    "dev": _pack("dev", "allow", 0.4, ("secrets-mask", SECRETS, "mask"), ("aadhaar-mask", ["AADHAAR"], "mask")),
    "dpdp": _law("dpdp"),
    "gdpr": _law("gdpr"),
    "hipaa-lite": _pack(
        "hipaa-lite", "block", 0.3,
        ("secrets-kill", SECRETS, "block", WITHHELD, "result"), ("names-block", ["PERSON_NAME"], "block"), ("contact-block", ["PHONE", "EMAIL"], "block"),
        ("location-dob-block", ["ADDRESS", "DOB"], "block"), ("account-block", ["BANK_ACCOUNT", "CREDIT_CARD"], "block"), ("govt-id-block", ["AADHAAR", "PAN", "GOVT_ID"], "block"),
        ("ip-block", ["IP_ADDRESS"], "block"), ("ifsc-allow", ["IFSC"], "allow"),
    ),
}


def load_preset(name: str, extra_entities: Iterable[str] = ()) -> Policy:
    if name not in PRESETS:
        raise PolicyError(f"unknown preset {name!r}; there are {sorted(PRESETS)}")
    return parse_policy(PRESETS[name], extra_entities)
