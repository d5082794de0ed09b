"""Prompt templates by set and name; the English set asks for the language of the question, the Chinese one for Chinese."""

from __future__ import annotations

STRATEGIES = ["Backtracking", "Exploring New Paths", "Verification", "Correction"]

_SHAPE = (
    'Reply with JSON only: {{"CoT": [{{"action": "Inner Thinking", "title": "...", "content": "..."}}, ..., '
    '{{"action": "Final Conclusion", "content": "..."}}, {{"action": "Verification", "content": "..."}}]}}'
)
_SEARCH = {
    "Backtracking": "Go back to an earlier step from which the reasoning went wrong, and reason on from there.",
    "Exploring New Paths": "Leave the reasoning so far and try a way that it has not taken.",
    "Verification": "Check each step of the reasoning so far and repair what does not hold.",
    "Correction": "Find the mistakes in the reasoning so far and put them right.",
}


def prompt_set(language: str = "same") -> dict[str, str]:
    """All templates; with `zh` the reasoning and the answer are asked for in Chinese."""
    say = "\nWrite in Chinese." if language == "zh" else ""
    out = {
        "filter": "Is this item hard, with just one answer, and can it be asked openly? Say Pass, Too Simple, Ambiguous Answer or Not Reformulatable.\n{question}\nAnswer: {answer}",
        "reformat": 'Turn the item into an open question with a short answer. Reply with JSON of two texts, "Open-ended Verifiable Question" and "Ground-True Answer".\n{question}\nAnswer: {answer}',
        "verify": "Does the conclusion agree with the answer? Say True or False.\nConclusion: {conclusion}\nAnswer: {answer}",
        "init": "Answer the question step by step.\n" + _SHAPE + say + "\nQuestion: {question}",
        "label": "The answer is {answer}. Reason towards it without saying that it was given; begin with a verification.\n" + _SHAPE + say + "\nQuestion: {question}\nSo far: {steps}",
        "rewrite": 'Tell this reasoning as a person would think aloud, over several lines. Reply with JSON: {{"NaturalReasoning": "..."}}' + say + "\nQuestion: {question}\nReasoning: {text}",
        "final": "Answer the question from this reasoning." + say + "\nQuestion: {question}\nReasoning: {text}",
        "strict": "Choose one option and end with: The answer is X.\n{question}\n{options}",
        "free": "Which option is right?\n{question}\n{options}",
        "reward": "{answer_text}\nIs this right, given the answer {gold}?{end}",
    }
    for name, how in _SEARCH.items():
        out[f"search:{name}"] = how + " Begin with a verification.\n" + _SHAPE + say + "\nQuestion: {question}\nSo far: {steps}"
    return out
