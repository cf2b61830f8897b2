"""Labels and explanations of the error classes, of our own wording."""

from __future__ import annotations

# Class: English label, template, template without a correction, rule.
SPECS = {
    "NON_WORD": ("Unknown word", "'{wrong}' is not in the lexicon; did you mean '{right}'?", "'{wrong}' is not in the lexicon.", "lexicon"),
    "HOMONYM": ("Word that sounds alike", "Beside this neighbour, '{right}' is meant rather than '{wrong}'.", "'{wrong}' may be another word that sounds alike.", "usage"),
    "NOTVA_SHOTVA": ("Spelling of na or sha", "'{wrong}' is spelled '{right}'.", "'{wrong}' breaks the rules of na and sha.", "na and sha"),
    "CASE_MARKER": ("Case ending", "'{right}' has the case that is needed, '{wrong}' has not.", "The case of '{wrong}' does not fit.", "case"),
    "CLASSIFIER": ("Classifier or plural", "Say '{right}' instead of '{wrong}'.", "'{wrong}' does not go with its noun.", "classifiers"),
    "VERB_INFLECTION": ("Ending of the verb", "With this subject the verb is '{right}', not '{wrong}'.", "'{wrong}' does not agree with its subject.", "persons"),
    "WORD_ORDER": ("Order of words", "Write '{right}'.", "The order of words is unusual.", "order"),
    "POS_ERROR": ("Part of speech", "'{right}' is the form that is needed here, not '{wrong}'.", "'{wrong}' is the wrong part of speech.", "parts of speech"),
    "AGREEMENT": ("Agreement", "'{wrong}' should be '{right}' to agree.", "'{wrong}' does not agree.", "agreement"),
    "GURUCHANDALI_DOSHA": ("Mixed registers", "'{wrong}' is of another register than the sentence; use '{right}'.", "'{wrong}' is of another register than the sentence.", "registers"),
    "REGISTER_INCONSISTENCY": ("Register of the text", "The register changes here.", "The register changes here.", "registers"),
    "PUNCTUATION": ("Punctuation", "Write '{right}' for '{wrong}'.", "Check the punctuation at '{wrong}'.", "punctuation"),
}
# The same in Bengali.
BENGALI = {
    "NON_WORD": ("অচেনা শব্দ", "'{wrong}' অভিধানে নেই; '{right}' কি?", "'{wrong}' অভিধানে নেই।"),
    "HOMONYM": ("সমোচ্চারিত শব্দ", "এখানে '{wrong}' নয়, '{right}' হবে।", "'{wrong}' অন্য শব্দ হতে পারে।"),
    "NOTVA_SHOTVA": ("ণত্ব ও ষত্ব", "'{wrong}' নয়, শুদ্ধ বানান '{right}'।", "'{wrong}' বানানে ভুল আছে।"),
    "CASE_MARKER": ("বিভক্তি", "'{wrong}' নয়, '{right}' হবে।", "'{wrong}' শব্দের বিভক্তি মেলে না।"),
    "CLASSIFIER": ("নির্দেশক ও বচন", "'{wrong}' নয়, '{right}' লিখুন।", "'{wrong}' মেলে না।"),
    "VERB_INFLECTION": ("ক্রিয়ার রূপ", "এই কর্তার সঙ্গে '{wrong}' নয়, '{right}' হবে।", "'{wrong}' কর্তার সঙ্গে মেলে না।"),
    "WORD_ORDER": ("শব্দের ক্রম", "'{right}' লিখুন।", "শব্দের ক্রম মেলে না।"),
    "POS_ERROR": ("পদ", "'{wrong}' নয়, '{right}' হবে।", "'{wrong}' ঠিক পদ নয়।"),
    "AGREEMENT": ("সঙ্গতি", "'{wrong}' নয়, '{right}' হবে।", "'{wrong}' মেলে না।"),
    "GURUCHANDALI_DOSHA": ("মিশ্র রীতি", "'{wrong}' অন্য রীতির; '{right}' লিখুন।", "'{wrong}' অন্য রীতির।"),
    "REGISTER_INCONSISTENCY": ("রীতির বদল", "এখানে রীতি বদলেছে।", "এখানে রীতি বদলেছে।"),
    "PUNCTUATION": ("যতিচিহ্ন", "'{wrong}' নয়, '{right}' লিখুন।", "'{wrong}' যতিচিহ্ন দেখুন।"),
}


def rows() -> list[tuple]:
    """(error_class, label, template, no_fix_template, label_bn, template_bn, no_fix_template_bn, rule_reference)"""
    return [(c, en[0], en[1], en[2], *BENGALI[c], en[3]) for c, en in SPECS.items()]


DDL = "error_class string, label string, template string, no_fix_template string, label_bn string, template_bn string, no_fix_template_bn string, rule_reference string"
