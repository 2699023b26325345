"""Word lists, phrases, patterns and constants. All are fixed values: results depend on them being as they are."""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.strip().split("\n")]


# --- fixed values: vocabulary ---
BAN_VERBS = _words("""
delve navigate foster leverage harness empower unlock catalyze galvanize utilize spearhead synergize operationalize
revolutionize supercharge elevate amplify streamline champion evangelize pioneer facilitate optimize incentivize
conceptualize contextualize problematize underscore showcase illuminate bolster reimagine transcend demystify unpack
unravel embark endeavor resonate captivate cultivate envision propel augment orchestrate curate architect ideate
accelerate align democratize deploy elucidate enable iterate reshape synthesize tackle""")
BAN_ADJECTIVES = _words("""
robust holistic paramount transformative cutting-edge seamless innovative groundbreaking comprehensive dynamic
game-changing best-in-class world-class state-of-the-art mission-critical enterprise-grade multifaceted nuanced pivotal
compelling invaluable indispensable unparalleled unprecedented myriad meticulous intricate vibrant bustling nestled
thoughtful noteworthy commendable remarkable insightful profound impactful actionable scalable bespoke granular
overarching undeniable instrumental versatile ubiquitous burgeoning nascent seminal salient cogent astute discerning
crucial data-driven disruptive ever-evolving integral proactive purpose-driven resilient strategic""")
BAN_FILLERS = _words("""
furthermore moreover additionally consequently nevertheless paradigm ecosystem synergy landscape realm tapestry
underpinning bedrock cornerstone linchpin crucible zeitgeist ethos nexus interplay juxtaposition plethora gamut spectrum
confluence dichotomy trajectory framework methodology stakeholder deliverable bandwidth synergistic proactive
aforementioned henceforth notwithstanding thereof whereby""")
BUZZWORDS = sorted({*BAN_VERBS, *BAN_ADJECTIVES, *BAN_FILLERS})
FILLER_PHRASES = _lines("""
a testament to
as such
at its core
at the forefront
best practices
building blocks
deep dive
double-edged sword
in essence
in light of
key takeaway
moving forward
to this end
what's more""")
DUAL_ADJECTIVES = _words("""
rich complex bold innovative nuanced layered diverse inclusive dynamic vibrant profound meaningful unique powerful
compelling engaging thoughtful intentional strategic holistic robust seamless elegant sophisticated comprehensive
transformative authentic genuine deep broad""")
FIRST_PERSON = _words("i me my mine myself we us our ours ourselves")
NOT_ADVERBS = _words("family only early likely friendly lonely ugly holy daily weekly monthly yearly rally belly jelly bully ally supply apply reply fly july italy")
INTENSIFIERS = _words("significantly dramatically fundamentally incredibly remarkably exceptionally profoundly thoroughly effectively efficiently seamlessly effortlessly meticulously strategically inherently ultimately")
SYNONYM_GROUPS = [_words(x) for x in _lines("""
important crucial vital essential critical paramount pivotal key fundamental
help assist aid support facilitate enable empower
show demonstrate illustrate highlight showcase underscore exemplify
use utilize leverage harness employ deploy implement
make create craft forge build develop construct establish
change transform revolutionize reshape redefine reimagine reinvent
big significant substantial considerable noteworthy remarkable profound
improve enhance elevate optimize refine strengthen bolster augment""")]
AI_OPENERS = _words("furthermore moreover additionally consequently nevertheless however therefore ultimately notably importantly significantly interestingly accordingly subsequently this these the it in")
HUMAN_OPENERS = _words("i we you he she they my so but and well yeah ok look honestly basically")
HEDGES_CLUSTERED = _lines("""
however
furthermore
moreover
additionally
consequently
nevertheless
notably
importantly
significantly
ultimately
it's worth noting
it should be noted
it is important to note
interestingly
remarkably
arguably
admittedly""")
STACK_STARTERS = _lines("""
moreover
furthermore
additionally
consequently
subsequently
similarly
likewise
conversely
nevertheless
nonetheless
in addition
as a result
on the other hand
in contrast""")
# Function words per 1000 words, and for the first thirty the standard deviation.
FUNCTION_WORDS = {w: float(f) for w, f in (x.split(":") for x in _words("""
the:69.97 of:36.41 and:28.85 to:26.15 a:23.08 in:21.34 that:10.59 is:10.10 was:9.78 it:9.97 for:9.49 as:7.70 with:7.17
his:6.50 on:6.09 be:6.39 at:5.30 by:5.07 i:5.16 this:4.57 had:4.89 not:4.60 are:4.39 but:4.15 from:3.97 or:3.57 have:3.57
an:3.28 they:2.77 which:2.90 one:2.63 you:2.89 were:2.51 her:2.44 all:2.41 she:2.10 there:2.09 would:1.92 their:1.87
we:1.85 him:1.71 been:1.72 has:1.64 when:1.62 who:1.55 will:1.53 no:1.41 more:1.38 if:1.37 out:1.31"""))}
DELTA_SD = [float(x) for x in _words("15.0 10.0 8.0 7.5 7.0 6.5 5.0 4.5 5.0 4.5 4.0 3.5 3.5 4.0 3.0 3.5 2.5 2.5 4.0 2.5 3.0 2.5 2.5 2.5 2.0 2.0 2.5 2.0 2.5 2.0")]

# --- fixed values: sentence patterns (case is ignored where (?i) stands) ---
HEDGES = _lines(r"""
(?i)\bhowever\b
(?i)\bfurthermore\b
(?i)\bmoreover\b
(?i)\badditionally\b
(?i)\bconsequently\b
(?i)\bnevertheless\b
(?i)\bnotably\b
(?i)\bimportantly\b
(?i)\bsignificantly\b
(?i)\bundoubtedly\b
(?i)\bultimately\b
(?i)\bit'?s fair to say\b
(?i)\bit bears mentioning\b
(?i)\bit stands to reason\b
(?i)\bgenerally speaking\b
(?i)\bbroadly speaking\b
(?i)\bby and large\b
(?i)\bmore often than not\b
(?i)\bneedless to say\b
(?i)\bgiven the circumstances\b""")
TRANSITIONS = _lines(r"""
(?i)^(In conclusion|To summarize|In summary|Overall|In essence)
(?i)^(It is worth noting|It should be noted|It is important to)
(?i)^(This (demonstrates|illustrates|highlights|underscores|showcases))
(?i)^(By (leveraging|utilizing|harnessing|implementing))""")
NOT_ONLY, IT_IS_TO, TRIAD = "(?i)not only .+ but also", r"(?i)it is \w+ to \w+", r"\w+, \w+, and \w+"
SANDWICH = "(?i)(certainly|clearly|undoubtedly|obviously).{10,}(however|but|although|though|yet).{10,}(still|nevertheless|ultimately|nonetheless)"
FRONT_LOADED = r"\b(the|a|an)\s+\w+\s+\w+\s+(and\s+)?\w+"
DUAL = r"\b(\w+)\s+and\s+(\w+)\b"
TRAILING = r",\s+\w+ing\b[^.]*[.!?]?$"
DECLARATIONS = _lines(r"""
(?i)\bfull stop\b
(?i)\blet that sink in\b
(?i)\band that'?s? okay\b
(?i)\band that'?s? fine\b
(?i)\bread that again\b
(?i)\bperiod\.\s*$
(?i)\bthink about that\b
(?i)\blet me be clear\b
(?i)\bmake no mistake\b
(?i)\bhere'?s? the (thing|truth|reality|kicker)\b
(?i)\bthe bottom line\b""")
DICHOTOMIES = _lines(r"""
(?i)it'?s?\s+not\s+(about|just|merely|simply)\b.*\bit'?s?\s+(about|really)
(?i)(this|that|it)\s+isn'?t\s+(about|just)\b
(?i)the (question|issue|point|problem)\s+isn'?t\b.*\bit'?s\b
(?i)don'?t\s+\w+\s*[.;]\s*(instead|rather)\b
(?i)stop\s+\w+ing\b.*\bstart\s+\w+ing\b""")
EXPOSITIONS = _lines(r"""
(?i)\bfelt\s+a\s+(pang|wave|rush|surge|flutter|stab|twinge|jolt)\s+of\b
(?i)\ba\s+(wave|surge|rush|flood|pang)\s+of\s+(sadness|joy|emotion|grief|relief|anger|anxiety|guilt|shame|pride|nostalgia)\b
(?i)\b(heart|stomach|chest)\s+(sank|clenched|tightened|fluttered|ached|swelled)\b
(?i)\btears\s+(pricked|stung|welled|burned)\b
(?i)\bbreath\s+(caught|hitched)\b
(?i)\bsomething\s+(shifted|stirred|broke|snapped)\s+(in|inside|within)\b""")
SIGNATURE_PHRASES = {
    "claude": _lines("""
it's worth noting
i'd be happy to
i should note
to be straightforward
that said,
i want to be direct
let me be transparent
it bears mentioning
i'd suggest
from my perspective"""),
    "gpt": _lines("""
certainly!
absolutely!
delve
straightforward
it's important to note
in today's
in conclusion,
overall,
game-changer
navigate the
landscape of
in the realm of"""),
    "gemini": _lines("""
here's a breakdown
key takeaways:
let's break this down
here are some
it's also worth mentioning
in summary,
to put it simply"""),
}
SIGNATURE_PATTERNS = {
    "claude": _lines(r"""
(?i)both .{3,40} and .{3,40} have (?:merit|value|strengths)
(?i)there are (?:multiple|several|various|different) perspectives
(?i)(?:nuanced|multifaceted) (?:issue|topic|question|situation)"""),
    "gpt": _lines(r"""
(?i)\*\*\d+\.\s
(?i)(?:Key|Main|Important|Critical) (?:takeaway|point|consideration|factor)s?:
(?i)(?:Let's|Let us) (?:explore|examine|discuss|look at)"""),
    "gemini": _lines(r"""
(?i)\*\s+\*\*.+\*\*
(?i)(?:First|Second|Third|Finally|Additionally),\s"""),
}

# --- fixed values: document patterns ---
CONTRACTIONS = (
    r"(?i)\b(i'm|i've|i'll|i'd|we're|we've|we'll|we'd|you're|you've|you'll|you'd|they're|they've|they'll|they'd|he's|she's|it's|that's|there's|here's|what's|who's|"
    r"isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|doesn't|don't|didn't|won't|wouldn't|can't|couldn't|shouldn't|mustn't|let's|ain't)\b"
)
EXPANDABLE = (
    r"(?i)\b(I am|I have|I will|I would|we are|we have|we will|we would|you are|you have|you will|you would|they are|they have|they will|they would|"
    r"he is|she is|it is|that is|there is|here is|what is|who is|is not|are not|was not|were not|has not|have not|had not|does not|do not|did not|will not|would not|can not|cannot|could not|should not|must not|let us)\b"
)
PASSIVE = r"(?i)\b(is|are|was|were|been|being|be)\s+(\w+ly\s+)?(\w+ed|built|made|seen|done|taken|given|found|known|shown|written|driven|spoken|broken|chosen|forgotten|hidden|proven|stolen|worn)\b"
NUMBERS, SPECIFICS = r"\b\d+[\d,.]*\b", r"(\$[\d,.]+|\d+%|\b(19|20)\d{2}\b|\d{1,2}:\d{2})"
SENSES = _lines(r"""
(?i)\b(saw|gazed|watched|looked|glanced|stared|peered|observed|glimpsed|noticed|eye|vision|bright|dark|glow|shimmer|gleam)\b
(?i)\b(heard|listened|whispered|murmured|echoed|hummed|rang|crackled|rustled|silence|voice|sound|noise|quiet)\b
(?i)\b(smelled|scent|aroma|fragrance|stench|whiff|pungent|musty|fresh|perfume|odor)\b
(?i)\b(felt|touched|rough|smooth|soft|hard|warm|cold|cool|texture|fingers|skin|grip|grasp|caress)\b
(?i)\b(tasted|flavor|sweet|bitter|sour|salty|savory|tongue|mouth|palate|delicious)\b""")
CONNECTORS = r"(?i)^(This|These|That|Those|Such|Here|The above|As mentioned|Building on|Continuing|Following|Returning to)\b"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{FE00}-\x{FE0F}\x{200D}]"
OPENING_PHRASES = _lines(r"""
(?i)^In today'?s\s+(rapidly\s+)?(evolving|changing|digital|modern|fast-paced|competitive)
(?i)^In the (world|realm|age|era|field|domain) of\b
(?i)^When it comes to\b
(?i)^In an (era|age|world) (of|where)\b
(?i)^As we (navigate|explore|delve|embark|look at)\b
(?i)^In the (ever-evolving|ever-changing|fast-paced)\b
(?i)^(The|This) (landscape|realm|domain|world) of\b
(?i)^It'?s no (secret|surprise|coincidence) that\b
(?i)^Have you ever (wondered|thought|considered)\b
(?i)^In (recent years|today's society|the modern world)\b
(?i)^Now more than ever\b
(?i)^Imagine a world where\b
(?i)^.{1,30}\s+is more than just\b
(?i)^In a world that is (constantly|always|ever)\b
(?i)^It goes without saying\b""")
CLOSINGS = _lines(r"""
in conclusion
to summarize
in summary
overall,?\s+(by|through|with)
by (leveraging|embracing|adopting|implementing|utilizing)
(position|prepare) (themselves|yourself|ourselves) for
long-term (success|growth|sustainability)
(paramount|essential|crucial|vital) to (achieving|ensuring|driving)
the (key|path|road|journey) to (success|growth)
moving forward
at the end of the day
all things considered
only time will tell
the possibilities are (endless|limitless|vast)
one thing is (certain|clear|sure)
as we continue to\b
it'?s clear that\b
in the final analysis""")
CLOSING_NEGATIVE = r"\b(challenge|risk|problem|issue|concern|difficult|fail|threat|drawback|limitation|obstacle|barrier|downside|danger|crisis)\b"
CLOSING_ASPIRATION = "(bright future|promising|opportunity|unlock|potential|success|transform|thrive|flourish|embrace|empower|the right approach)"
DIGRESSIONS = _lines(r"""
\bby the way\b
\bspeaking of\b
\breminds me\b
\bside note\b
\bon a tangent\b
\banyway\b
\bactually,?\s
\boh,?\s
\bwell,?\s
\bbtw\b
\bfwiw\b
\bi mean\b
\byou know\b
\bfunny (thing|story|enough)\b
\brandom(ly)?\b
\b(which|that) reminds me\b
\bnow that i think\b
\bcome to think of it\b""")
BALANCES = _lines(r"""
while .{5,50}, it'?s (also|equally|important)
on (the )?one hand.{5,100}on the other
it'?s (important|worth|essential) to (note|consider|acknowledge)
(that said|having said that|with that said)
(however|nevertheless),?\s+(it'?s|we|the)""")
OPINIONS = _lines(r"""
\b(honestly|frankly|obviously|clearly)\b
\bi (think|believe|feel|hate|love)\b
\b(terrible|amazing|awful|brilliant|stupid|ridiculous)\b
\b(no way|absolutely not|definitely|hell no|damn)\b
\bshould (never|always)\b""")
CASUAL = r"(?i)\b(honestly|look,|here'?s the thing|basically|you know|frankly|truth be told)\b"
AS_YOU_KNOW = "(?i)\"[^\"]*\\b(as you know|as I'?m sure you'?re aware|you remember when|as we both know|you'?ll recall)\\b[^\"]*\""

# --- fixed values: genres ---
GENRE_WORDS = {
    "academic": _words("study research analysis findings hypothesis methodology participants results significant correlation data sample statistical literature et al conclusion abstract variables"),
    "casual": _words("i you we gonna wanna kinda yeah ok lol haha dunno tbh honestly basically stuff thing things guys cool awesome"),
    "business": _words("stakeholders roi kpi deliverables synergy pipeline quarterly revenue strategy initiative alignment scalable leverage optimize metrics"),
    "resume": _words("experience responsibilities proficient managed developed implemented skills team led achieved bachelor master certification"),
    "creative": _words("whispered echoed shadows moonlight silence breath trembling darkness heart soul dream murmured gaze softly"),
    "memoir": _words("remember remembered childhood grew father mother years old family home school friends life story stories decided realized felt thought"),
    "poetry": [],
    "literary": _words("whom whilst hitherto wherein countenance therefore indeed manner exclaimed replied observed remarked henceforth accordingly"),
}
CONTRACTED, I_PAST = r"\b\w+'(?:t|s|re|ve|ll|d|m)\b", r"\bI\s+(?:was|had|went|saw|felt|thought|knew|decided|remember)"
#: Floor of machine text and ceiling of human text.
GENRE_BOUNDS = {"general": (30, 25), "academic": (30, 40), "casual": (25, 22), "business": (35, 25), "creative": (22, 28), "resume": (30, 25), "memoir": (25, 30), "poetry": (20, 40), "literary": (22, 35)}
#: Mean and standard deviation of MATTR, and of TTR.
GENRE_RICHNESS = {
    "academic": (0.7607375891028592, 0.06802502259626075, 0.6565595238095238, 0.06215977579397604),
    "news": (0.7689032984423875, 0.08833173537031228, 0.6670116834838025, 0.0743735556470682),
    "fiction": (0.7448470573636143, 0.07880028730069268, 0.6396018751508048, 0.07413339521449934),
    "casual": (0.771094734823975, 0.09148289749338319, 0.6716936289195127, 0.09247678015878663),
    "business": (0.7767897457537716, 0.06576674025560235, 0.6764243845252051, 0.06018722618253257),
    "general": (0.7576457623987566, 0.0826688646314371, 0.654711883940072, 0.07592069303460827),
}
#: Weights of document signals; 0.5 for a signal that isn't listed, 0 when only counting.
WEIGHTS = {k: float(v) for k, v in (x.split(":") for x in _words("""
sentence_opener_pos:1.0 contractions:1.0 entity_density:1.0 ai_opening_phrases:1.0 ai_phrases:0.9 buzzwords:0.9
compression_ratio:0.8 length_uniformity:0.8 hedge_words:0.8 dual_adjectives:0.7 false_dichotomy:0.7 synonym_treadmill:0.7
opening_diversity:0.7 yules_k:0.7 adverb_density:0.7 digression_absence:0.67 hedge_clusters:0.6 transition_stacks:0.6
emotional_exposition:0.6 hapax_legomena:0.6 paragraph_uniformity:0.6 structural_patterns:0.5 vocabulary_richness:0.5
transitions:0.5 char_ngram_profile:0.5 tricolon_density:0.5 buzzword_density:0.6 rhetorical_question_chain:0.5
circular_repetition:0.4 hollow_informality:0.3 as_you_know_exposition:0.4 bullet_subheading_overuse:0.5
word_length_distribution:0.48 first_person:0.35 emoji_density:0.3 trailing_participial:0.3 confident_declarations:0.25
self_contained_paragraphs:0.2 punctuation_fingerprint:0.2 zipf_deviation:0 function_word_deviation:0 burrows_delta:0
readability:0 em_dash_overuse:0 passive_voice:0 mattr:0 sensory_checklist:0 question_exclamation_absence:0
oxford_comma_consistency:0 closing_summary:0.4 consensus_middle:0 compression_ratio_sentence:0
compression_ratio_document:0 repetition_density:0 ngram_perplexity:0 ngram_burstiness:0 zipf_deviation_v2:0 mattr_v2:0
ttr_variance:0 semantic_monotony:0.8 chunked_consistency:0.4 model_fingerprint:0.7"""))}

# --- fixed values: stock phrases by category ---
PHRASES = {
    "vague_abstractions": "the intricacies of|the complexities of|the nuances of|the fabric of|the landscape of|the realm of|the tapestry of|the intersection of|the forefront of|the cornerstone of|the bedrock of|the linchpin of|the hallmark of|the crux of|the heart of the matter|a wide range of|a myriad of|a plethora of|a wealth of|a diverse range of|a broad spectrum of|a multitude of|a variety of factors|an array of|an integral part of".split("|"),
    "false_depth": "it's worth noting that|it is worth noting that|it's important to note that|it is important to note that|it's important to understand that|it is important to understand that|it's essential to consider|it is essential to consider|it's crucial to understand|it is crucial to understand|this raises important questions about|this raises interesting questions about|the implications are far-reaching|the implications of this|given the fact that|due to the fact that|in light of the fact that|based on the information provided|there's no one-size-fits-all|there is no one-size-fits-all|the answer is nuanced|both sides have valid points|reasonable people can disagree|this is particularly true|this is especially true".split("|"),
    "metaphor_cliches": "serves as a testament to|a testament to the|a testament to|stands as a beacon of|serves as a reminder|serves as a catalyst|serves as a foundation|a double-edged sword|the tip of the iceberg|paves the way for|paving the way for|bridges the gap between|bridging the gap between|strikes a balance between|striking a balance between|sheds light on|shedding light on|plays a crucial role|plays a vital role|plays a pivotal role|plays an important role|a key role in|a driving force behind|at the forefront of|at the heart of|on the cutting edge of|a game changer for|a stepping stone|a stark reminder".split("|"),
    "corporate_action": "unlock the potential of|unlock the power of|unlock the secrets of|unleash the power of|harness the power of|embark on a journey|embarking on a journey|push the boundaries of|pushing the boundaries of|capitalize on the opportunities|navigate the complexities|navigating the complexities|navigate the challenges|lay the groundwork for|laying the groundwork for|foster a culture of|fostering a culture of|drive meaningful change|driving meaningful change|delve into the world of|delve into the intricacies|spearhead the initiative|take it to the next level|a gateway to|the key to success".split("|"),
    "hedging_fillers": "one could argue that|one might argue that|it could be argued that|it depends on various factors|while there's no definitive answer|while there is no definitive answer|it goes without saying|it is important to understand|bearing in mind that|with that in mind|in light of this|in light of these|it's a complex issue|it is a complex issue|can potentially|might arguably|to some extent|in many ways|at the end of the day|when all is said and done|all things considered|to put it simply|simply put|in other words|that being said|having said that|with that said".split("|"),
    "false_insider": "if you're like most|if you are like most|we've all been there|we have all been there|let's be honest|let us be honest|let's face it|let us face it|here's the thing|here is the thing|no one talks about this|nobody talks about this|you're not alone|you are not alone|whether you're a|whether you are a|here's what nobody tells you|here is what nobody tells you|i get it|i understand your frustration|i hear you|that's a great question|that is a great question|we all know|as we all understand|i hope this email finds you well|i wanted to reach out".split("|"),
}
ANY_PHRASE = r"(?i)\b(?:" + "|".join(sorted((p.replace("'", "['’]") for ps in PHRASES.values() for p in ps), key=lambda p: (-len(p), p))) + r")\b"
