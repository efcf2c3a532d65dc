"""Word lists and phrase tables. They are data: every function that uses one takes it as a parameter."""

# Triggers of a question and the search variants each group adds, in order.
QUESTION_TOPICS = [
    (
        ["shit", "defecate", "urinate", "pee", "bathroom", "toilet", "public restroom"],
        [
            "public urination defecation prohibited",
            "indecent conduct public decency",
            "disorderly conduct public behavior",
            "public health sanitation violations",
            "nuisance public place bathroom",
        ],
    ),
    (["fence", "wall", "height"], ["residential fence height 20.16.030", "fence screening wall residential"]),
    (["animal", "tiger", "pet", "dog"], ["animal control dangerous animals", "exotic animal prohibition"]),
    (["business", "commercial", "store"], ["business license commercial", "zoning commercial activity"]),
]

# Bonus points for phrases in the content of a section.
QUALITY_BONUS = [
    (8, ["prohibited", "unlawful", "shall not", "violation"]),
    (6, ["public place", "indecent", "disorderly"]),
    (10, ["urinate", "defecate", "excrete"]),
    (3, ["permitted", "allowed", "shall", "required"]),
]

# Bonus points for the first matching prefix of a section number.
SECTION_BONUS = [("20.16", 15), ("18.", 10), ("7.", 8), ("10.", 12), ("9.", 14), ("8.", 16)]

# Phrases by which an answer asks for more material (quick and strict form).
NEEDS_MORE = ["would need to see", "need additional sections", "not provided in these sections", "additional information"]
NEEDS_MORE_STRICT = [
    "would need to see",
    "need to see more sections",
    "these specific sections do not provide",
    "does not contain any information about",
    "would need additional sections",
    "I would need to see other sections",
    "these sections don't address",
    "need more information",
    "require additional sections",
    "not provided in these sections",
    "would need access to",
    "additional ordinances",
    "other parts of the code",
    "need to consult other sections",
]

# Follow-up search for the first matching group of words in an answer or question.
QUICK_TOPICS = [
    (["fence", "wall"], "fence height zoning"),
    (["animal"], "animal control ordinance"),
    (["business"], "business license"),
    (["permit"], "permit requirements"),
]

# First matching topic of a question and its searches.
TOPIC_SEARCHES = [
    (
        ["shit", "defecate", "urinate", "pee", "bathroom", "toilet"],
        [
            "public decency ordinance",
            "disorderly conduct public",
            "nuisance public behavior",
            "sanitation violations",
            "public restroom requirements",
        ],
    ),
    (
        ["tiger", "lion", "bear", "wolf", "exotic animal", "wild animal"],
        ["dangerous animal ownership", "exotic animal permits", "wild animal prohibition", "animal control regulations"],
    ),
    (
        ["fence", "wall", "build", "construct", "height"],
        ["fence height regulations", "residential building codes", "property line restrictions", "zoning setback requirements"],
    ),
    (
        ["business", "store", "commercial", "license"],
        ["business license requirements", "commercial zoning regulations", "permit commercial activity"],
    ),
    (["noise", "loud", "music", "party"], ["noise ordinance", "disturbance public peace", "quiet hours regulations"]),
]

# Searches added for what an answer says.
CONTEXT_DECENCY = ["public indecency definition", "offenses against decency"]
CONTEXT_PERMIT = ["permit application requirements"]
CONTEXT_ZONING = ["zoning code regulations"]
CONTEXT_SILENT = ["prohibited activities ordinance"]
