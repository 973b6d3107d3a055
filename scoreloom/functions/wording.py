"""Prompt wording.

Fixed values: sentences that models are shown, or that are looked for in stored
prompts and must be found to the letter. Each is the default of a parameter.
"""

SUBJECT_INTRO = (
    "The following are multiple choice questions (with answers) about ",
    ". Answer with the option letter from the given choices directly.",
)

THREAT_ASKED = (
    "You are given a multiple-choice question (MCQ) from a Cyber Threat Intelligence (CTI) "
    "knowledge benchmark dataset. Your task is to choose the best option among the four "
    "provided. Return your answer as a single uppercase letter: A, B, C, or D."
)
THREAT_LAST_LINE = (
    "The last line of your answer should contain only the single letter corresponding to "
    "the best option, with no additional text."
)
THREAT_DIRECT = (
    "Please provide the letter corresponding to the best option (A, B, C, D), with no "
    "additional text. **Answer:**"
)

WEAKNESS_STORED = "Analyze the following CVE description and map it to the appropriate CWE."
WEAKNESS_ASKED = (
    "Analyze the following CVE description and map it to the appropriate CWE. "
    "Answer the CWE ID in the format CWE-XXXX."
)
WEAKNESS_CUE = "The CWE is"

SEVERITY_ASKED = (
    "Analyze the following CVE description and calculate the CVSS v3.1 Base Score. Determine "
    "the values for each base metric: AV, AC, PR, UI, S, C, I, and A. Summarize each metric's "
    "value and provide the final CVSS v3.1 vector string. Valid options for each metric are as "
    "follows: - **Attack Vector (AV)**: Network (N), Adjacent (A), Local (L), Physical (P) - "
    "**Attack Complexity (AC)**: Low (L), High (H) - **Privileges Required (PR)**: None (N), "
    "Low (L), High (H) - **User Interaction (UI)**: None (N), Required (R) - **Scope (S)**: "
    "Unchanged (U), Changed (C) - **Confidentiality (C)**: None (N), Low (L), High (H) - "
    "**Integrity (I)**: None (N), Low (L), High (H) - **Availability (A)**: None (N), Low (L), "
    "High (H) Summarize each metric's value and provide the final CVSS v3.1 vector string. "
    "Ensure the final line of your response contains only the CVSS v3 Vector String in the "
    "following format: Example format: CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
)
SEVERITY_CUE = "The CVSS v3.1 vector string is"

TECHNIQUES_ASKED = (
    "Extract all MITRE Enterprise attack patterns from the following text and map them to their "
    "corresponding MITRE technique IDs. Provide reasoning for each identification. Ensure the "
    "final line contains only the IDs for the main techniques, separated by commas, excluding "
    "any subtechnique IDs. MITRE Enterprise IDs are given below as reference."
)
TECHNIQUES_CUE = "**Extracted Mitre IDs**:"

INLINE_CUE = "Choose the correct answer (A, B, C, or D) only."

LETTERS_ASKED = (
    "You are given multiple choice questions. Answer with the option letter (A, B, C, D) from "
    "the given choices directly."
)
LETTER_ASKED = (
    "You are given multiple choice questions. Answer with the option letter from the given "
    "choices directly."
)

ANSWER_SET_ASKED = (
    "Below are multiple-choice questions concerning cybersecurity. Please select the correct "
    "answers and strictly respond with the letters ABCD (A, B, C, D, AB, AC, AD, BC, BD, CD, "
    "ABC, ABD, ACD, BCD, ABCD) only. Do not include any explanations."
)
