"""Bengali pack: compact tables of our own, from common grammar.

Words are folded when the module loads (NFC, the three dotted letters composed),
so that it doesn't matter how they are typed."""

from __future__ import annotations

from scriptorium.functions.normalize import folded_word as f
from scriptorium.functions.tokenize import BENGALI
from scriptorium.packs.base import Collocation, Pack


def words(text: str) -> tuple[str, ...]:
    return tuple(f(w) for w in text.split())


def pairs(text: str) -> dict[str, str]:
    flat = words(text)
    return dict(zip(flat[::2], flat[1::2], strict=True))


# Wrong and right spellings under the rules of na and sha.
VIOLATIONS = pairs(
    "কারন কারণ ধারন ধারণ গ্রহন গ্রহণ প্রান প্রাণ বর্ননা বর্ণনা লবন লবণ সাধারন সাধারণ উচ্চারন উচ্চারণ "
    "আচরন আচরণ আক্রমন আক্রমণ ব্যাকরন ব্যাকরণ উদাহরন উদাহরণ প্রমান প্রমাণ পরিমান পরিমাণ নির্মান নির্মাণ স্মরন স্মরণ মরন মরণ চরন চরণ "
    "করুনা করুণা তরুন তরুণ ভাষন ভাষণ ঘোষনা ঘোষণা গবেষনা গবেষণা ভীষন ভীষণ দূষন দূষণ শোষন শোষণ বিশেষন বিশেষণ আকর্ষন আকর্ষণ "
    "কৃপন কৃপণ ঋন ঋণ তৃন তৃণ ঘৃনা ঘৃণা বর্ন বর্ণ স্বর্ন স্বর্ণ পূর্ন পূর্ণ চূর্ন চূর্ণ দক্ষিন দক্ষিণ লক্ষন লক্ষণ প্রশিক্ষন প্রশিক্ষণ কল্যান কল্যাণ "
    "গনিত গণিত গননা গণনা বানিজ্য বাণিজ্য নিপুন নিপুণ লাবন্য লাবণ্য পুন্য পুণ্য দুর্ণীতি দুর্নীতি দুর্ণাম দুর্নাম "
    "কস্ট কষ্ট নস্ট নষ্ট স্পস্ট স্পষ্ট দুস্ট দুষ্ট মিস্টি মিষ্টি বৃস্টি বৃষ্টি সৃস্টি সৃষ্টি দৃস্টি দৃষ্টি চেস্টা চেষ্টা অনুস্ঠান অনুষ্ঠান বিসয় বিষয় "
    "পুরষ্কার পুরস্কার নমষ্কার নমস্কার আবিস্কার আবিষ্কার পরিস্কার পরিষ্কার ষ্টেশন স্টেশন ষ্টুডিও স্টুডিও মাষ্টার মাস্টার জিনিষ জিনিস"
)
# Older spellings and the standard ones.
STANDARD_FORMS = pairs(
    "বাঙালী বাঙালি গাড়ী গাড়ি বাড়ী বাড়ি শাড়ী শাড়ি সরকারী সরকারি দেশী দেশি কাহিনী কাহিনি "
    "পাখী পাখি হাতী হাতি রানী রানি চাকরী চাকরি জানুয়ারী জানুয়ারি ফেব্রুয়ারী ফেব্রুয়ারি লাইব্রেরী লাইব্রেরি কোম্পানী কোম্পানি "
    "ইংরেজী ইংরেজি জরুরী জরুরি খুশী খুশি বেশী বেশি তৈরী তৈরি ফরাসী ফরাসি"
)
# Pairs of archaic and modern forms.
REGISTER = pairs(
    "তাহার তার তাহারা তারা তাহাকে তাকে যাহা যা তাহা তা ইহা এটা উহা ওটা করিয়া করে হইয়া হয়ে যাইয়া গিয়ে কহিল বলল হইল হলো নাই নেই "
    "আসিয়া এসে খাইয়া খেয়ে পাইয়া পেয়ে শুনিয়া শুনে উঠিয়া উঠে বসিয়া বসে যাহারা যারা কাহাকে কাকে "
    "তাহাদের তাদের যাহার যার যাহাকে যাকে যাহাদের যাদের কাহার কার কাহাদের কাদের ইহার এর ইহাকে একে ইহারা এরা ইহাদের এদের উহার ওর উহাকে ওকে উহারা ওরা উহাদের ওদের "
    "দিয়াছে দিয়েছে দিয়াছি দিয়েছি গিয়াছে গিয়েছে গিয়াছি গিয়েছি লইয়া নিয়ে দিয়া দিয়ে চাহিয়া চেয়ে গাহিয়া গেয়ে রহিয়া রয়ে কহিয়া কয়ে "
    "কহিলেন বললেন কহিলাম বললাম হইল হলো হইবে হবে হইতে হতে হইলে হলে যাইতে যেতে যাইবে যাবে যাইব যাব খাইতে খেতে খাইবে খাবে আসিতে আসতে আসিবে আসবে "
    "পাইবে পাবে পাইতে পেতে লইতে নিতে লইবে নেবে নহে নয় নহেন নন নাহি নেই"
)
ARCHAIC_ENDINGS = words("িতেছে িতেছি িতেছেন িতেছ িতেছিল িতেছিলাম িতেছিলেন িয়াছে িয়াছি িয়াছেন িয়াছ িয়াছিল িয়াছিলাম িয়াছিলেন িলাম িলেন িবেন িবার")
GUARDED_ENDINGS = words("িয়া িবে িল")
REGISTER_VERBS = words("কর বল চল দেখ লিখ পড় জান খেল শুন ধর")
PRIORITY_MODERN = words("চ্ছে চ্ছি চ্ছেন চ্ছিল")
MODERN_ENDINGS = words("েছে েছি েছেন েছিল ছে ছি ছেন লাম বেন")
DERIVED = pairs("িতেছে ছে িতেছি ছি িতেছেন ছেন িতেছ ছো িতেছিল ছিল িতেছিলাম ছিলাম িতেছিলেন ছিলেন িয়াছে েছে িয়াছি েছি িয়াছেন েছেন িয়াছ েছো িয়াছিল েছিল িয়াছিলাম েছিলাম িয়াছিলেন েছিলেন িলাম লাম িলেন লেন িবেন বেন িবার বার িবে বে িল ল িয়া ে")
# A word that is modern only after some others, and its archaic form.
CONTEXTUAL = {f("পরে"): (f("পরিয়া"), words("জামা শাড়ি কাপড় জুতা টুপি"))}
# Subjects and their persons.
SUBJECTS = pairs("আমি first আমরা first তুমি second তোমরা second তুই intimate তোরা intimate সে third তারা third তিনি honorific আপনি honorific আপনারা honorific")
AMBIGUOUS_SUBJECTS = words("তার কে")
PARADIGMS = {
    "present": pairs("first ি second ো third ে honorific েন intimate িস"),
    "progressive": pairs("first ছি second ছো third ছে honorific ছেন intimate ছিস"),
    "perfect": pairs("first েছি second েছো third েছে honorific েছেন intimate েছিস"),
    "past": pairs("first লাম second লে third লো honorific লেন intimate লি"),
    "future": pairs("first বো second বে third বে honorific বেন intimate বি"),
    "habitual": pairs("first তাম second তে third তো honorific তেন intimate তিস"),
    "past progressive": pairs("first ছিলাম second ছিলে third ছিল honorific ছিলেন intimate ছিলি"),
    "past perfect": pairs("first েছিলাম second েছিলে third েছিল honorific েছিলেন intimate েছিলি"),
    "imperative": pairs("third ুক honorific ুন"),
}
AMBIGUOUS_ENDINGS = words("বে লে ে তে")
FINAL_ONLY = words("ি ো")
ROOTS = words(
    "কর বল চল দেখ লিখ পড় জান খেল শুন ধর হাস কাঁদ বস উঠ নাচ ভাব মার কাট রাখ থাক ডাক খুঁজ বুঝ মান ঘুর ফির ছাড় আন কিন চিন "
    "বাঁচ ঢাক মুছ ভাঙ গড় তুল দৌড় সাজ রাঁধ বাঁধ কাঁপ মিল নাম লাগ জাগ রাগ ভাস থাম টান মাপ চাপ পার মর ঝর"
)
CLAUSE_BREAKS = words("এবং কিন্তু আর যে তবে কারণ যদি তাই অথবা বা")
PARTICLES = words("না নি কি তো ও ই")
NOT_VERBS = words("বলে করে পড়ে ধরে")
PHRASE_HEADS = words("সঙ্গে কাছে জন্য মতো")
QUANTIFIERS = words("অনেক সব বহু সকল কয়েকটি কিছু")
PLURAL_SUFFIXES = words("গুলো গুলি সমূহ")
PLURAL_PERSON = f("রা")
CLASSIFIERS = words("টি টা খানা জন")
# Classifiers that a number before them takes in.
BARE_CLASSIFIERS = words("জন টি টা")
THING_TO_PERSON = pairs("একটা একজন একটি একজন দুটো দুজন দুটি দুজন তিনটি তিনজন তিনটা তিনজন")
PERSON_TO_THING = pairs("একজন একটি দুজন দুটি তিনজন তিনটি")
PERSON_NOUNS = words("শিক্ষক ছাত্র ডাক্তার লোক মেয়ে ছেলে মানুষ কৃষক লেখক শিল্পী নার্স উকিল পুলিশ রোগী যাত্রী শ্রমিক নেতা বন্ধু গায়ক মালী")
THING_NOUNS = words("বই কলম গাছ টেবিল চেয়ার ঘর নদী ফুল খাতা থালা জামা ঘড়ি নৌকা চাবি বাক্স রাস্তা দরজা জানালা ছবি চিঠি")
POSSESSIVES = {f("তারা"): pairs("তার তাদের"), f("আমরা"): pairs("আমার আমাদের"), f("তোমরা"): pairs("তোমার তোমাদের")}
ANY_PLURAL_POSSESSIVE = pairs("তার তাদের")
COLLOCATIONS = (
    Collocation(f("দিন"), f("দীন"), before=words("দুঃখী দরিদ্র"), confidence=0.70),
    Collocation(f("শব"), f("সব"), before=words("সময় মানুষ"), confidence=0.74),
    Collocation(f("কুল"), f("কূল"), after=words("নদীর সাগরের"), confidence=0.66),
    Collocation(f("বান"), f("বাণ"), after=words("তীর ধনুক"), confidence=0.60),
)
SUFFIXES = words("কে ের র তে ে েরা দের গুলো গুলি সমূহ রা টি টা খানা জন ই ও ছে ছি ছেন েছে েছি েছেন লাম লেন বেন তাম ি েন ছিলাম ছিল ছিলেন েছিলাম েছিল েছিলেন ুন ুক")
PREFIXES = words("অ অতি উপ প্রতি প্র বি সু")
VOWEL_FINAL_ONLY = words("র তে য় ও")
SEED = words(
    "আমি আমরা তুমি তোমরা সে তারা তিনি আপনি এবং কিন্তু আর না কি তো ভালো মন্দ দিন রাত সময় মানুষ বই কলম গাছ নদী ফুল ঘর বাড়ি গাড়ি দেশ ভাষা বাংলা "
    "শিক্ষক ছাত্র ডাক্তার লোক মেয়ে ছেলে কৃষক লেখক টেবিল চেয়ার কর বল চল দেখ লিখ পড় জান খেল শুন ধর ভাত জল মাছ স্কুল কাজ কথা গল্প গান কবিতা "
    "সব অনেক বহু সকল কিছু আজ কাল এখন তখন কারণ গ্রহণ প্রাণ বর্ণনা লবণ পুরস্কার পরিষ্কার আবিষ্কার দীন দুঃখী কূল নদীর তার তাদের আমার আমাদের তোমার তোমাদের "
    "শিল্পী নার্স উকিল পুলিশ রোগী যাত্রী শ্রমিক নেতা বন্ধু গায়ক মালী খাতা থালা জামা ঘড়ি নৌকা চাবি বাক্স রাস্তা দরজা জানালা ছবি চিঠি "
    "আকাশ বাতাস পানি মাটি আগুন পাহাড় সাগর গ্রাম শহর বাজার দোকান হাট মাঠ পুকুর বাগান পথ সেতু আলো ছায়া রোদ মেঘ ঝড় শীত গরম বর্ষা "
    "মা বাবা ভাই বোন দাদা দিদি কাকা মামা নানা শিশু পরিবার হাত পা মাথা চোখ কান নাক মুখ মন শরীর রক্ত "
    "লাল নীল সবুজ হলুদ কালো সাদা বড় ছোট নতুন পুরনো সুন্দর ভারী হালকা গভীর সহজ কঠিন দ্রুত ধীরে কাছে দূরে উপরে নিচে ভেতরে বাইরে "
    "সকাল দুপুর বিকেল সন্ধ্যা সপ্তাহ মাস বছর শব্দ বাক্য অক্ষর চিন্তা স্বপ্ন আশা ভয় আনন্দ সুখ শান্তি যুদ্ধ ইতিহাস বিজ্ঞান সাহিত্য সঙ্গীত খবর "
    "একটি একজন দুটি দুজন তিনটি তিনজন যাচ্ছে খাচ্ছে করছে বলল করে বলে হয়ে গিয়ে হলো নেই"
)

PACK = Pack(
    code="bn", rules=BENGALI, script="bengali", violations=VIOLATIONS, standard_forms=STANDARD_FORMS, register=REGISTER, archaic_endings=ARCHAIC_ENDINGS,
    guarded_endings=GUARDED_ENDINGS, register_verbs=REGISTER_VERBS, priority_modern=PRIORITY_MODERN, modern_endings=MODERN_ENDINGS, derived=DERIVED,
    contextual=CONTEXTUAL, subjects=SUBJECTS, ambiguous_subjects=AMBIGUOUS_SUBJECTS, paradigms=PARADIGMS, ambiguous_endings=AMBIGUOUS_ENDINGS, final_only=FINAL_ONLY,
    roots=ROOTS, clause_breaks=CLAUSE_BREAKS, particles=PARTICLES, not_verbs=NOT_VERBS, phrase_heads=PHRASE_HEADS, quantifiers=QUANTIFIERS,
    plural_suffixes=PLURAL_SUFFIXES, plural_person=PLURAL_PERSON, classifiers=CLASSIFIERS, bare_classifiers=BARE_CLASSIFIERS, thing_to_person=THING_TO_PERSON, person_to_thing=PERSON_TO_THING, person_nouns=PERSON_NOUNS, thing_nouns=THING_NOUNS,
    possessives=POSSESSIVES, any_plural_possessive=ANY_PLURAL_POSSESSIVE, collocations=COLLOCATIONS, suffixes=SUFFIXES, prefixes=PREFIXES,
    vowel_final_only=VOWEL_FINAL_ONLY, lexicon=SEED, coverage=1.0,
)
