"""Training-data operators: near duplicates, chat formatting, personal data,
decontamination, URL rules, source mixing, language-model scores, toxicity,
language identification and quality rules. Nothing else in the library
imports this package."""
