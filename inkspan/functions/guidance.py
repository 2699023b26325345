"""Fixed values of style guides: labels of elements, how each is asked for, and what to write instead of a pattern."""

from __future__ import annotations

#: Readable names of elements.
ELEMENT_LABELS = {
    "contraction_rate": "contractions",
    "avg_sentence_length": "average sentence length",
    "sentence_length_stddev": "sentence length variety",
    "short_sentence_ratio": "short sentences",
    "long_sentence_ratio": "long sentences",
    "fragment_usage": "sentence fragments",
    "passive_voice_rate": "passive voice constructions",
    "em_dash_usage": "em dashes",
    "semicolon_usage": "semicolons",
    "ellipsis_usage": "ellipses",
    "exclamation_rate": "exclamation marks",
    "parenthetical_usage": "parenthetical asides",
    "rhetorical_question_rate": "rhetorical questions",
    "first_person_usage": "first-person pronouns (I, we, my)",
    "second_person_usage": "second-person pronouns (you, your)",
    "vocabulary_richness": "vocabulary diversity",
    "avg_word_length": "average word length",
    "long_word_frequency": "long words (6+ characters)",
    "jargon_level": "technical jargon",
    "flesch_kincaid_grade": "Flesch-Kincaid grade level",
    "flesch_reading_ease": "Flesch reading ease score",
    "gunning_fog_index": "Gunning Fog index",
    "coleman_liau_index": "Coleman-Liau index",
    "smog_index": "SMOG index",
    "automated_readability_index": "Automated Readability Index",
    "function_word_rate": "function word frequency",
    "article_rate": "article usage (a/an/the)",
    "preposition_rate": "preposition frequency",
    "lexical_density": "content word density",
    "hapax_legomena_ratio": "unique word ratio (hapax legomena)",
    "nominalization_rate": "nominalizations (-tion, -ment, -ness)",
    "conjunction_opening_rate": "conjunction sentence openers (And/But/So)",
    "sentence_opener_variety": "sentence opener diversity",
    "coordinating_conjunction_rate": "coordinating conjunctions (and/but/or)",
    "subordinating_conjunction_rate": "subordinating conjunctions (because/although/if)",
    "avg_clause_complexity": "clause complexity per sentence",
    "paragraph_avg_length": "average paragraph length (sentences)",
    "single_sentence_paragraph_ratio": "single-sentence paragraphs",
    "quotation_density": "quoted material density",
    "third_person_usage": "third-person pronouns (he/she/they)",
    "modal_verb_rate": "modal verbs (can/could/would/should)",
    "comma_rate": "commas per sentence",
    "colon_usage": "colons",
    "discourse_marker_rate": "discourse markers (actually/basically/clearly)",
    "hedging_language_rate": "hedging language (perhaps/maybe/somewhat)",
    "intensifier_rate": "intensifiers (very/really/extremely)",
    "transition_word_rate": "transition words (however/therefore/moreover)",
    "adjective_to_noun_ratio": "adjective-to-noun ratio",
    "adverb_density": "adverb density",
    "verb_tense_past_ratio": "past tense verb ratio",
    "verb_tense_present_ratio": "present tense verb ratio",
    "clause_depth_avg": "average clause depth",
    "named_entity_density": "named entity density (people/places/orgs)",
    "sentiment_mean": "average emotional tone",
    "sentiment_variance": "emotional range/variance",
    "sentiment_shift_rate": "sentiment polarity shift frequency",
    "topic_coherence_score": "topic coherence across paragraphs",
    "topic_drift_rate": "topic drift between paragraphs",
    "vocabulary_concentration": "vocabulary concentration (top-term dominance)",
    "paragraph_opening_pos_entropy": "variety in how paragraphs begin grammatically",
    "narrative_vs_analytical_ratio": "preference for storytelling vs analytical writing",
}
#: How each element is asked for.
STRATEGY = {
    "adjective_to_noun_ratio": "english",
    "adverb_density": "json_enforced",
    "archaic_vocabulary_rate": "json",
    "article_rate": "targeted_enforcement",
    "automated_readability_index": "json_enforced",
    "avg_clause_complexity": "hybrid",
    "avg_sentence_length": "hybrid",
    "avg_word_length": "english",
    "clause_depth_avg": "json_enforced",
    "coleman_liau_index": "english",
    "colon_usage": "hybrid",
    "comma_rate": "hybrid",
    "conjunction_opening_rate": "json_enforced",
    "contraction_rate": "json",
    "coordinating_conjunction_rate": "hybrid",
    "discourse_marker_rate": "hybrid",
    "ellipsis_usage": "targeted_enforcement",
    "em_dash_usage": "json",
    "exclamation_rate": "targeted_enforcement",
    "figurative_language_markers": "targeted_enforcement",
    "first_person_usage": "targeted_enforcement",
    "flesch_kincaid_grade": "json_enforced",
    "flesch_reading_ease": "english",
    "function_word_rate": "json",
    "gunning_fog_index": "json_enforced",
    "hapax_legomena_ratio": "english",
    "hedging_language_rate": "targeted_enforcement",
    "intensifier_rate": "targeted_enforcement",
    "inverted_syntax_rate": "hybrid",
    "lexical_density": "json",
    "long_sentence_ratio": "targeted_enforcement",
    "long_word_frequency": "english",
    "modal_verb_rate": "json",
    "named_entity_density": "targeted_enforcement",
    "narrative_vs_analytical_ratio": "targeted_enforcement",
    "nominalization_rate": "english",
    "paragraph_avg_length": "english",
    "paragraph_opening_pos_entropy": "json_enforced",
    "parenthetical_usage": "targeted_enforcement",
    "passive_voice_rate": "targeted_enforcement",
    "preposition_rate": "json_enforced",
    "quotation_density": "targeted_enforcement",
    "rare_word_rate": "english",
    "repetition_rate": "hybrid",
    "rhetorical_question_rate": "json",
    "second_person_usage": "hybrid",
    "semicolon_usage": "targeted_enforcement",
    "sentence_length_stddev": "targeted_enforcement",
    "sentence_opener_variety": "json_enforced",
    "sentiment_mean": "hybrid",
    "sentiment_shift_rate": "json",
    "sentiment_variance": "hybrid",
    "short_sentence_ratio": "targeted_enforcement",
    "single_sentence_paragraph_ratio": "targeted_enforcement",
    "smog_index": "json_enforced",
    "subordinating_conjunction_rate": "json_enforced",
    "third_person_usage": "english",
    "topic_coherence_score": "targeted_enforcement",
    "topic_drift_rate": "json_enforced",
    "transition_word_rate": "targeted_enforcement",
    "verb_tense_past_ratio": "targeted_enforcement",
    "verb_tense_present_ratio": "targeted_enforcement",
    "vocabulary_concentration": "english",
    "vocabulary_richness": "english",
    "vocative_usage": "json",
}
#: Elements that are left out of guides, since detection decides on them.
DETECTION_WINS = ["em_dash_usage"]
#: Instructions of elements that are enforced; {count} is worked out from the weight.
TEMPLATES = {
    "article_rate": "Target an article usage rate (a, an, the) of approximately {count} per 100 words",
    "ellipsis_usage": "Include {count} ellipses (...) for trailing thoughts or pauses",
    "exclamation_rate": "You MUST include at least {count} sentence that ends with an exclamation mark (!). This is a signature voice marker -- do not omit it.",
    "figurative_language_markers": "Include {count} figurative expression(s) such as metaphors, similes, or vivid imagery",
    "first_person_usage": "Use first-person pronouns (I, me, my, we, our) approximately {count} times",
    "hedging_language_rate": "Include hedging phrases (perhaps, might, seems, arguably) approximately {count} times",
    "intensifier_rate": "Use {count} intensifier(s) (very, really, extremely, incredibly, absolutely) naturally in your sentences",
    "long_sentence_ratio": "Approximately {count}% of sentences should be 25+ words",
    "named_entity_density": "Include specific names, places, or organizations — approximately {count} per 100 words",
    "narrative_vs_analytical_ratio": "Write {count}% analytical, the remainder narrative/anecdotal",
    "parenthetical_usage": "Include {count} parenthetical aside(s) using parentheses (like this) to add conversational commentary",
    "passive_voice_rate": "Use passive voice in approximately {count}% of sentences",
    "quotation_density": "Include {count} direct quotes or cited phrases in quotation marks",
    "semicolon_usage": "Use {count} semicolon(s) to join related independent clauses",
    "sentence_length_stddev": "Vary sentence lengths significantly — mix very short (under 8 words) with long (25+ words)",
    "short_sentence_ratio": "Approximately {count}% of sentences should be under 8 words",
    "single_sentence_paragraph_ratio": "Write at least {count} paragraph(s) that contain ONLY a single sentence -- one sentence then a paragraph break. Example: a short punchy statement standing alone as its own paragraph.",
    "topic_coherence_score": "Stay focused on a coherent topic thread — target coherence around {count}",
    "transition_word_rate": "Use {count} formal transition word(s) such as however, therefore, meanwhile, furthermore, or nevertheless",
    "verb_tense_past_ratio": "Use past tense in approximately {count}% of verbs",
    "verb_tense_present_ratio": "Use present tense in approximately {count}% of verbs",
}
#: What to write instead of a pattern; a key stands for all patterns that begin with it.
PATTERN_RULES = {
    "buzzword": "BANNED WORDS (see list below). Replace every one with plain English.",
    "no_contractions": "Use contractions naturally (don't, can't, it's, I've, we're).",
    "low_contractions": "Use contractions naturally (don't, can't, it's, I've, we're).",
    "uniform_length": "Vary sentence lengths dramatically: mix short punchy sentences (<6 words) with long flowing ones (25+).",
    "rule_of_three": "Never list exactly 3 things. Use 2 or 4+.",
    "tricolon": "Never list exactly 3 things. Use 2 or 4+.",
    "ai_transition": "Don't open sentences with Furthermore/Moreover/Additionally/Consequently.",
    "transition_stack": "Don't open sentences with Furthermore/Moreover/Additionally/Consequently.",
    "hedge_word": "Cut hedge words. State things directly instead of hedging.",
    "hedge_cluster": "Cut hedge words. State things directly instead of hedging.",
    "hedge_regular": "Cut hedge words. State things directly instead of hedging.",
    "trailing_participial": "Never end a sentence with an -ing participial phrase.",
    "no_digressions": "Include one brief tangent or personal aside.",
    "few_digressions": "Include one brief tangent or personal aside.",
    "no_irregular_punctuation": "Use at least 1 rhetorical question and 1 exclamation or ellipsis.",
    "no_questions_exclamations": "Use at least 1 rhetorical question and 1 exclamation or ellipsis.",
    "rare_questions_exclamations": "Use at least 1 rhetorical question and 1 exclamation or ellipsis.",
    "self_contained": "Reference something from early in the text later — create a thread.",
    "ai_opening_phrase": "Don't open with 'In today's world' or similar AI cliché openers.",
    "closing_summary": "Don't summarize at the end. End mid-thought or with a question.",
    "em_dash": "NO em dashes (—). Use commas, periods, or parentheses instead.",
    "ai_phrase": "Avoid these AI phrases: {phrases}.",
    "emotional_exposition": "Show emotions through actions and dialogue, not 'felt a pang of' or 'a wave of sadness'.",
    "dual_adjective": "Don't pair adjectives ('rich and complex'). Pick one strong word.",
    "uniform_paragraph": "Vary paragraph lengths — some 1-2 sentences, some 5+.",
    "low_paragraph_variance": "Vary paragraph lengths — some 1-2 sentences, some 5+.",
    "uniform_para": "Vary paragraph lengths — some 1-2 sentences, some 5+.",
    "synonym_treadmill": "Don't rotate fancy synonyms for the same concept. Pick one word and reuse it.",
    "false_dichotomy": "Don't use 'It's not about X, it's about Y' constructions.",
    "not_only_but_also": "Don't use 'not only X but also Y' constructions.",
    "hedging_sandwich": "Don't hedge-bold-hedge. Commit to your point.",
    "confident_declaration": "Don't make sweeping declarations. Be specific with evidence.",
    "circular_repetition": "Don't repeat intro phrases in your conclusion.",
    "rhetorical_question_chain": "Don't chain multiple rhetorical questions in a row.",
    "hollow_informality": "If you use casual markers like 'honestly' or 'look', follow through with something genuinely personal.",
    "front_loaded_description": "Don't front-load heavy descriptions before the action.",
    "it_is_adj_to": "Don't use impersonal 'It is [adjective] to [verb]' constructions.",
    "heavy_structure": "Use fewer bullet points and subheadings. Write in flowing prose.",
    "moderate_structure": "Use fewer bullet points and subheadings. Write in flowing prose.",
    "high_comma_density": "Use fewer commas. Break long sentences into shorter ones instead.",
    "semicolon_overuse": "Avoid semicolons. Use periods instead.",
    "low_vocabulary_richness": "Use more varied vocabulary — don't repeat the same words.",
}
