"""Driver-side configuration: providers and models, INI files, prompts, command lines."""

from __future__ import annotations

import ast
import configparser
from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    provider: str
    name: str
    api_key: str
    base_url: str


def yaml_mapping(text: str) -> dict:
    """Nested mappings of plain YAML: `key: value` by indentation, # comments, quotes. No lists, no tags."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        depth = len(bare) - len(bare.lstrip())
        key, sep, value = bare.strip().partition(":")
        if not sep:
            raise ValueError(f"not a mapping: {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip("\"'")] = value.strip().strip("\"'")
        else:
            stack[-1][1][key.strip("\"'")] = inner = {}
            stack.append((depth, inner))
    return root


def resolve_model(config: dict, model: str, provider: str | None = None, fallback: Model | None = None) -> Model:
    """The model under any provider; else the provider's first model; else the fallback."""
    for p, models in config.items():
        if isinstance(models, dict) and isinstance(models.get(model), dict):
            return _model(p, models[model], model)
    if provider and isinstance(config.get(provider), dict) and config[provider]:
        name, first = next(iter(config[provider].items()))
        return _model(provider, first, name)
    if fallback:
        return fallback
    raise KeyError(f"no configuration for model {model!r}")


def _model(provider: str, entry: dict, name: str) -> Model:
    return Model(provider, entry.get("model", name), entry.get("api_key", ""), entry.get("base_url", ""))


def ini_values(text: str) -> dict:
    """All settings of an INI file as literals where they are literals; nothing is evaluated."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    out = {}
    for section in parser.sections():
        for k, v in parser.items(section):
            try:
                out[k] = ast.literal_eval(v)
            except (ValueError, SyntaxError):
                out[k] = v
    return out


#: Request texts in this engine's own words; {names} are filled by functions.text.fill_template.
PROMPTS = {
    "keyfacts": "List the key facts of the text as a JSON array of objects with entity, behavior, context and priority (1 most important, 3 least). Answer with JSON only.\n\nText:\n{text}",
    "alignment": "Pair facts of list A with facts of list B that state the same entity and behavior. Use each fact once. Answer with a JSON array of [A fact, B fact] pairs only.\n\nA: {generated}\nB: {truth}",
    "coherence": "Rate how well the text holds together from 1 to 5. Answer in the form `Coherence: <number>`.\n\n{text}",
    "questions": "Write {n} multiple-choice questions with options A to D on these facts, as a JSON array of objects with question, options and answer.\n\n{facts}",
    "reader": "You are a reader of {age}. Using the text alone, answer each question with one letter, as a JSON array.\n\nText:\n{text}\n\nQuestions:\n{questions}",
    "sections": 'Rate from 0 to 10 how much each section has to do with the article. Answer as {"scores": [..]} in the order of the sections.\n\n{payload}',
}
READERS = {"child": "about ten years", "teenager": "about fifteen years", "adult": "adult age"}
