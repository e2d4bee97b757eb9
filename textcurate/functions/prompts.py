"""Prompt templates and the columns made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that models were trained on or are asked with, formats that their answers have.
INSTRUCTION = (
    "Rewrite the input into a Telegram post in style type {style_type}. Preserve the facts, but match the tone, structure, pacing, and ending typical for this style."
)
PROMPT = (
    "Below is an instruction that describes a task, paired with an input that provides further context.\n"
    "Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
)
RESPONSE_MARK = "### Response:"
END_MARKS = ["</s>", "<|endoftext|>", "<eos>", "<|im_end|>", "<|end|>"]
USER_TEMPLATES = {
    "rewrite": "Нейтрализуй текст.\n<source_text>\n{text}\n</source_text>",
    "brief": "Преобразуй пост в краткий нейтральный бриф.\nВерни тему и не более {fact_limit} фактологических пунктов.\n<source_text>\n{text}\n</source_text>",
    "brief_v2": "Сделай компактный factual brief в формате editor notes.\nТема: короткая.\nФакты: не более {fact_limit} коротких пунктов.\n<source_text>\n{text}\n</source_text>",
    "brief_v3": (
        "Преобразуй пост в structured factual brief.\nНужны поля: topic, entities, numbers, facts.\n"
        "Ограничения: entities <= {fact_limit}, numbers <= {fact_limit}, facts <= {fact_limit}.\n<source_text>\n{text}\n</source_text>"
    ),
    "brief_v4": "Сделай компактный factual brief для другой модели.\nТема: короткая.\nФакты: не более {fact_limit} коротких пунктов.\n<source_text>\n{text}\n</source_text>",
}
ANSWER_FIELDS = {
    "rewrite": {"neutral_text": "string"},
    "brief": {"topic": "string", "facts": "array"},
    "brief_v2": {"topic": "string", "facts": "array"},
    "brief_v3": {"topic": "string", "entities": "array", "numbers": "array", "facts": "array"},
    "brief_v4": {"topic": "string", "facts": "array"},
}
ANSWER_NAMES = {"rewrite": "neutralization_result", "brief": "brief_result", "brief_v2": "brief_result_v2", "brief_v3": "brief_result_v3", "brief_v4": "brief_result_v4"}


def modes() -> list[str]:
    return list(USER_TEMPLATES)


def check_mode(mode: str) -> str:
    if mode not in USER_TEMPLATES:
        raise ValueError(f"Unknown prompt mode {mode!r}. Available: {', '.join(modes())}")
    return mode


def system_prompt(mode: str, fact_limit: int = 5) -> str:
    """What a text backend is told before the user prompt of a mode."""
    fields = ", ".join(ANSWER_FIELDS[check_mode(mode)])
    task = "перепиши сообщение нейтрально" if mode == "rewrite" else f"извлеки тему и факты (не более {fact_limit} в списке)"
    return f"Ты редактор фактов: {task}. Сохрани числа, даты и имена, ничего не добавляй, не копируй длинные фразы. Верни только JSON с полями: {fields}."


def response_format(mode: str) -> dict:
    """The JSON schema that a backend's answer must meet."""
    kinds = {"string": {"type": "string"}, "array": {"type": "array", "items": {"type": "string"}}}
    fields = ANSWER_FIELDS[check_mode(mode)]
    schema = {"type": "object", "properties": {k: kinds[v] for k, v in fields.items()}, "required": list(fields), "additionalProperties": False}
    return {"type": "json_schema", "json_schema": {"name": ANSWER_NAMES[mode], "strict": True, "schema": schema}}


def _fill(template: str, values: dict[str, Column]) -> Column:
    """The template's named places filled with columns, in one concat."""
    parts, rest = [], template
    while rest:
        at = {rest.find("{" + k + "}"): k for k in values if "{" + k + "}" in rest}
        if not at:
            parts.append(F.lit(rest))
            break
        i, k = min(at), at[min(at)]
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(values[k])
        rest = rest[i + len(k) + 2 :]
    return F.concat(*parts)


def instruction(style_type: Column) -> Column:
    return _fill(INSTRUCTION, {"style_type": style_type})


def inference_prompt(style_type: Column, text: Column) -> Column:
    return _fill(PROMPT, {"instruction": instruction(style_type), "input": text})


def training_prompt(style_type: Column, text: Column, response: Column) -> Column:
    return F.concat(inference_prompt(style_type, text), response)


def user_prompt(text: Column, mode: str = "rewrite", fact_limit: int = 5) -> Column:
    return _fill(USER_TEMPLATES[check_mode(mode)].replace("{fact_limit}", str(fact_limit)), {"text": text})


def extract_response(full: Column) -> Column:
    """What follows the last response mark, without end marks; texts without the mark are only stripped."""
    from .text import strip

    after = strip(F.substring_index(full, RESPONSE_MARK, -1))
    for mark in END_MARKS:
        after = F.replace(after, F.lit(mark), F.lit(""))
    return F.when(F.contains(full, F.lit(RESPONSE_MARK)), strip(after)).otherwise(strip(full))
