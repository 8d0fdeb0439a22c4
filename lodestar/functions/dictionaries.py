"""Names and abbreviations of the domain. Fixed values."""

from __future__ import annotations

SCHEMES = (
    "Nadu-Nedu", "Nadu Nedu", "Naadu-Nedu", "Amma Vodi", "Amma Vodi Scheme", "Ammavodi", "Jagananna Gorumudda", "Gorumudda", "Mid Day Meal", "MDM Scheme", "Jagananna Vidya Deevena", "Vidya Deevena",
    "Jagananna Vidya Kanuka", "Vidya Kanuka", "Jagananna Amma Odi", "Smart School Programme", "Smart Schools", "Digital Classroom Initiative", "Mana Badi Nadu Nedu", "Vasathi Deevena", "Teacher Training Programme",
    "In-Service Teacher Training", "DIET Programme", "District Institute of Education and Training", "SC/ST Welfare Schemes", "BC Welfare Hostel Scheme", "EWS Scholarship Scheme", "Minority Welfare Scheme",
    "Girl Child Education Scheme", "Kasturba Gandhi Balika Vidyalaya", "KGBV", "Inclusive Education Scheme", "CWSN Support Programme", "Children With Special Needs", "Quality Improvement Programme",
    "School Quality Assessment", "Learning Enhancement Programme", "Skill Development Programme", "Vocational Education Scheme", "Samajik Abhisarata Programme", "Sarva Shiksha Abhiyan", "SSA",
    "Rashtriya Madhyamik Shiksha Abhiyan", "RMSA", "Samagra Shiksha", "Beti Bachao Beti Padhao", "BBBP", "Atal Tinkering Labs", "ATL", "Grama/Ward Sachivalayam Education Programme", "Bridge Course Programme",
)
DISTRICTS = (
    "Anantapur", "Ananthapuramu", "Ananthapuram", "Chittoor", "Chittor", "East Godavari", "East Godavari District", "Godavari East", "Guntur", "Krishna", "Krishna District", "Kurnool", "Nellore", "Nellore District",
    "SPSR Nellore", "Sri Potti Sriramulu Nellore", "Prakasam", "Prakasam District", "Srikakulam", "Sri Kakulam", "Visakhapatnam", "Vishakhapatnam", "Vizag", "Vizag District", "Vizianagaram", "Vijayanagaram",
    "West Godavari", "West Godavari District", "Godavari West", "YSR Kadapa", "YSR", "Kadapa", "Cuddapah",
)
SOCIAL_CATEGORIES = (
    "SC", "Scheduled Caste", "Scheduled Castes", "ST", "Scheduled Tribe", "Scheduled Tribes", "OBC", "Other Backward Class", "Other Backward Classes", "BC", "Backward Class", "Backward Classes", "EWS",
    "Economically Weaker Section", "Economically Weaker Sections", "BC-A", "BC-B", "BC-C", "BC-D", "BC-E", "Girl Child", "Girl Students", "Female Students", "Boy Students", "Male Students", "Below Poverty Line", "BPL",
    "Above Poverty Line", "APL", "Rural Students", "Urban Students", "Tribal Area Students", "Minority Students", "Muslim Minority", "Christian Minority", "Children With Special Needs", "CWSN", "Differently Abled",
    "Divyang", "Orphan Students", "Orphans",
)
SCHOOL_TYPES = (
    "Government School", "Govt School", "Government Schools", "Zilla Parishad School", "ZP School", "ZPHS", "ZPSS", "Mandal Parishad School", "MPP School", "MPPS", "Municipal School", "Corporation School", "Private School",
    "Private Schools", "Aided School", "Aided Schools", "Unaided School", "Unaided Schools", "Private Aided", "Private Unaided", "Residential School", "Residential Schools", "Welfare Residential School",
    "Tribal Welfare School", "APTWRS", "BC Welfare Hostel", "SC/ST Welfare Hostel", "Kasturba Gandhi Balika Vidyalaya", "KGBV", "Model School", "Model Schools", "Sainik School", "Navodaya Vidyalaya", "JNV",
    "Kendriya Vidyalaya", "KV", "Primary School", "Upper Primary School", "High School", "Higher Secondary School", "Junior College",
)
EDUCATION_LEVELS = (
    "Pre-Primary", "Pre Primary", "Anganwadi", "Primary", "Primary Level", "Classes I-V", "Class 1 to 5", "Upper Primary", "Classes VI-VIII", "Class 6 to 8", "Secondary", "High School", "Classes IX-X", "Class 9 to 10",
    "Higher Secondary", "Intermediate", "Classes XI-XII", "Class 11 to 12", "Junior College", "Class I", "Class II", "Class III", "Class IV", "Class V", "Class VI", "Class VII", "Class VIII", "Class IX", "Class X",
    "Class XI", "Class XII", "SSC", "10th Standard", "10th Class", "12th Standard", "12th Class", "Science Stream", "Commerce Stream", "Arts Stream", "MPC", "BiPC", "CEC", "HEC",
)
#: Acronym -> its first expansion.
ACRONYMS = {
    "RTE": "Right to Education", "NEP": "National Education Policy", "UDISE": "Unified District Information System for Education", "UDISE+": "Unified District Information System for Education Plus", "PTR": "Pupil-Teacher Ratio",
    "GER": "Gross Enrollment Ratio", "NER": "Net Enrollment Ratio", "SSA": "Sarva Shiksha Abhiyan", "RMSA": "Rashtriya Madhyamik Shiksha Abhiyan", "NCERT": "National Council of Educational Research and Training",
    "SCERT": "State Council of Educational Research and Training", "NCTE": "National Council for Teacher Education", "NAS": "National Achievement Survey", "ASER": "Annual Status of Education Report", "MDM": "Mid-Day Meal",
    "GO": "Government Order", "DSC": "District Selection Committee", "TRT": "Teacher Recruitment Test", "NCPCR": "National Commission for Protection of Child Rights", "AP": "Andhra Pradesh", "BCE": "Backward Class Education",
    "SC": "Scheduled Caste", "ST": "Scheduled Tribe", "OBC": "Other Backward Classes", "EWS": "Economically Weaker Sections", "PWD": "Person with Disability", "KGBV": "Kasturba Gandhi Balika Vidyalaya", "AWC": "Anganwadi Centre",
    "ICDS": "Integrated Child Development Services", "SMS": "School Management System", "MIS": "Management Information System",
}
DISTRICT_ALIASES = {
    "vizag": "Visakhapatnam", "visakhapatnam": "Visakhapatnam", "vishakhapatnam": "Visakhapatnam", "vijayawada": "Vijayawada", "bezawada": "Vijayawada", "guntur": "Guntur", "tirupati": "Tirupati", "tirupathi": "Tirupati",
    "rajahmundry": "Rajahmundry", "rajahmundri": "Rajahmundry", "rajamahendravaram": "Rajahmundry",
}
#: Misspelt word of a query -> the word.
SPELLING = {
    "enrolment": "enrollment", "enrolement": "enrollment", "sceme": "scheme", "scheem": "scheme", "guvernment": "government", "goverment": "government", "teachr": "teacher", "techer": "teacher",
    "studnt": "student", "stuent": "student", "educaton": "education", "eduction": "education", "ammavodi": "amma vodi", "nadunedu": "nadu-nedu",
}
#: Names that a query may give.
GAZETTEER = {
    "districts": ("Visakhapatnam", "Vijayawada", "Guntur", "Tirupati", "Rajahmundry", "Anantapur", "Chittoor", "Kurnool", "Nellore", "Kadapa", "Prakasam", "Srikakulam", "Vizianagaram"),
    "schemes": ("Nadu-Nedu", "Jagananna Amma Vodi", "Jagananna Gorumudda", "Vidya Deevena", "Vasathi Deevena", "Mid-Day Meal Scheme", "Sarva Shiksha Abhiyan", "Rashtriya Madhyamik Shiksha Abhiyan", "Jagananna Vidya Kanuka", "YSR Vidya Volunteers", "Netanna Nestham", "Kalyana Lakshmi", "Shaadi Mubarak"),
    "metrics": ("enrollment", "dropout rate", "PTR", "GER", "NER", "infrastructure", "budget allocation", "teacher strength", "student strength", "literacy rate", "completion rate", "transition rate", "repetition rate", "learning outcomes"),
    "institutions": ("primary school", "upper primary school", "high school", "higher secondary school", "junior college", "degree college", "university", "polytechnic", "ITI", "residential school", "model school", "Kasturba Gandhi Balika Vidyalaya", "Eklavya Model Residential School"),
}


def any_of(names) -> str:
    """A pattern for any of the names as whole words, the first of the list that fits."""
    import re

    return r"(?i)\b(?:" + "|".join(re.escape(n).replace("\\ ", " ").replace("\\-", "-") for n in names) + r")\b"
