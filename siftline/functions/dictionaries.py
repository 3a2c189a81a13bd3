"""Dictionaries of the screening engine.

The tables below are fixed values: results follow from them, so they are
stated as they are, in natural order.
"""

from __future__ import annotations

SECTIONS = (
    "personal_information", "summary", "work_experience", "education", "skills", "certifications", "projects", "other",
)

SECTION_ALIASES = {
    "skills": (
        "skills", "technical skills", "technical skill", "core skills", "key skills", "professional skills", "competencies",
        "technical competencies", "core competencies", "expertise", "areas of expertise", "skills & expertise", "skills and expertise",
    ),
    "work_experience": (
        "experience", "work experience", "professional experience", "employment history", "work history", "career history",
        "professional background", "employment", "career experience",
    ),
    "education": (
        "education", "educational background", "academic background", "academic qualifications", "qualifications", "academic history",
    ),
    "certifications": (
        "certifications", "certificates", "professional certifications", "licenses and certifications", "certification",
    ),
    "projects": (
        "projects", "academic projects", "personal projects", "key projects", "project experience", "project work",
    ),
    "summary": (
        "summary", "professional summary", "career summary", "profile", "professional profile", "objective", "career objective", "about me",
    ),
    "personal_information": (
        "personal information", "personal details", "contact", "contact information", "contact details",
    ),
}

#: In this order ties between sections are broken.
CONTENT_KEYWORDS = {
    "skills": (
        "python", "java", "javascript", "typescript", "c++", "c#", "sql", "html", "css", "react", "angular", "django", "flask", "fastapi",
        "tensorflow", "pytorch", "scikit-learn", "machine learning", "deep learning", "docker", "kubernetes", "aws", "azure", "git",
        "github", "figma", "flutter", "excel", "power bi", "rest api", "rest apis",
    ),
    "work_experience": (
        "worked", "developed", "implemented", "designed", "managed", "led", "built", "created", "maintained", "optimized", "engineered",
        "deployed", "responsible", "experience", "developer", "engineer", "manager", "analyst", "intern", "consultant",
    ),
    "education": (
        "bachelor", "master", "phd", "doctorate", "degree", "university", "college", "school", "b.sc", "m.sc", "bca", "mca", "b.tech",
        "m.tech", "computer science", "graduated", "gpa",
    ),
    "certifications": (
        "certified", "certification", "certificate", "license", "credential", "aws certified", "microsoft certified", "oracle certified",
        "google certified",
    ),
    "projects": (
        "project", "developed an application", "built an application", "github", "repository", "prototype", "capstone",
        "implemented a system", "developed a system",
    ),
    "summary": (
        "innovative", "professional", "experienced", "motivated", "passionate", "specialized", "expertise", "proven track record", "career",
    ),
    "personal_information": ("email", "phone", "mobile", "address", "linkedin", "github", "location"),
}

MASTER_SKILLS = {
    "programming_languages": (
        "Python", "Java", "JavaScript", "TypeScript", "C", "C++", "C#", "Go", "Rust", "PHP", "Ruby", "Kotlin", "Swift", "Dart", "R", "MATLAB",
    ),
    "web_development": (
        "HTML", "CSS", "React", "Angular", "Vue.js", "Next.js", "Node.js", "Express.js", "Django", "Flask", "FastAPI", "Spring",
        "Spring Boot", "Laravel", "ASP.NET", "Nginx", "Apache",
    ),
    "databases": (
        "SQL", "MySQL", "PostgreSQL", "MongoDB", "Oracle", "SQLite", "Redis", "Firebase", "DynamoDB", "MariaDB", "Cassandra",
    ),
    "ai_ml": (
        "Artificial Intelligence", "Machine Learning", "Deep Learning", "Natural Language Processing", "Computer Vision",
        "Neural Networks", "TensorFlow", "PyTorch", "Scikit-learn", "Keras", "OpenCV", "Hugging Face", "Transformers", "Generative AI",
        "Large Language Models", "LLM",
    ),
    "data": (
        "Data Science", "Data Analysis", "Data Visualization", "Pandas", "NumPy", "Matplotlib", "Seaborn", "Power BI", "Tableau", "Excel",
        "Statistics", "Data Mining",
    ),
    "devops_cloud": (
        "Git", "GitHub", "GitLab", "Docker", "Kubernetes", "Jenkins", "CI/CD", "Terraform", "Ansible", "AWS", "Azure", "Google Cloud", "GCP",
        "Linux", "Bash", "CloudFormation", "CodeDeploy", "Lambda",
    ),
    "mobile": ("Flutter", "Android", "iOS", "React Native", "SwiftUI", "Jetpack Compose"),
    "creative": (
        "UI Design", "UX Design", "UI/UX Design", "Figma", "Adobe Photoshop", "Adobe Illustrator", "Adobe XD", "Graphic Design",
        "Wireframing", "Prototyping", "Visual Design", "Brand Design", "Typography", "Motion Graphics", "Video Editing",
    ),
    "business": (
        "Project Management", "Product Management", "Business Analysis", "Business Intelligence", "Market Research", "Digital Marketing",
        "SEO", "Content Marketing", "Sales", "Customer Relationship Management", "CRM", "Leadership", "Team Management", "Communication",
        "Presentation", "Problem Solving", "Time Management",
    ),
}

SYNONYMS = {
    "python3": "Python", "python 3": "Python", "python 3.x": "Python", "py": "Python",
    "js": "JavaScript", "javascript es6": "JavaScript", "javascript es2015": "JavaScript", "ecmascript": "JavaScript",
    "ts": "TypeScript",
    "reactjs": "React", "react js": "React", "react.js": "React",
    "node": "Node.js", "nodejs": "Node.js", "node js": "Node.js", "node.js": "Node.js",
    "vuejs": "Vue.js", "vue js": "Vue.js", "vue.js": "Vue.js",
    "angularjs": "Angular", "angular js": "Angular",
    "postgres": "PostgreSQL", "postgresql database": "PostgreSQL", "postgres database": "PostgreSQL",
    "mysql database": "MySQL", "mongo": "MongoDB", "mongodb database": "MongoDB", "mariadb database": "MariaDB",
    "ai": "Artificial Intelligence",
    "ml": "Machine Learning", "machine-learning": "Machine Learning",
    "dl": "Deep Learning", "deep-learning": "Deep Learning",
    "nlp": "Natural Language Processing", "natural-language processing": "Natural Language Processing",
    "cv": "Computer Vision", "computer-vision": "Computer Vision",
    "tensorflow 2": "TensorFlow", "tensorflow2": "TensorFlow", "tensorflow 2.x": "TensorFlow", "tensor flow": "TensorFlow",
    "tensor-flow": "TensorFlow", "tensorflow": "TensorFlow",
    "sklearn": "Scikit-learn", "scikit learn": "Scikit-learn", "scikitlearn": "Scikit-learn", "scikit-learn": "Scikit-learn",
    "pytorch framework": "PyTorch",
    "git version control": "Git", "git vcs": "Git", "version control": "Git",
    "github repository": "GitHub", "github repos": "GitHub",
    "amazon web services": "AWS", "amazon aws": "AWS",
    "microsoft azure": "Azure",
    "google cloud platform": "Google Cloud", "gcp cloud": "Google Cloud",
    "continuous integration": "CI/CD", "continuous deployment": "CI/CD", "continuous integration and deployment": "CI/CD",
    "continuous integration continuous deployment": "CI/CD",
    "ui ux": "UI/UX Design", "ui/ux": "UI/UX Design", "ui ux design": "UI/UX Design",
    "user interface design": "UI Design", "user experience design": "UX Design",
    "figma design": "Figma", "adobe photoshop": "Adobe Photoshop", "adobe illustrator": "Adobe Illustrator",
}

SKILL_STACKS = {
    "MERN": ("MongoDB", "Express.js", "React", "Node.js"),
    "MEAN": ("MongoDB", "Express.js", "Angular", "Node.js"),
    "MEVN": ("MongoDB", "Express.js", "Vue.js", "Node.js"),
    "LAMP": ("Linux", "Apache", "MySQL", "PHP"),
    "LEMP": ("Linux", "Nginx", "MySQL", "PHP"),
}

#: (evidence, section) to confidence; an empty section stands for all others.
CONFIDENCE = {
    ("canonical", "skills"): 0.98, ("canonical", "work_experience"): 0.91, ("canonical", "projects"): 0.88,
    ("canonical", "summary"): 0.86, ("canonical", ""): 0.90,
    ("synonym", "skills"): 0.94, ("synonym", "work_experience"): 0.88, ("synonym", "projects"): 0.85,
    ("synonym", "summary"): 0.83, ("synonym", ""): 0.86,
    ("skill_stack", ""): 0.96, ("derived", ""): 0.84, ("candidate_profile", ""): 0.80, ("unknown", ""): 0.70,
}

#: Sections that are searched for skills, in order of priority.
SKILL_SECTIONS = ("skills", "work_experience", "projects", "summary")

RESUME_KEYWORDS = (
    "Python", "Java", "JavaScript", "C++", "C#", "Django", "Flask", "FastAPI", "React", "HTML", "CSS", "SQL", "MySQL", "PostgreSQL", "MongoDB",
    "REST API", "REST APIs", "Git", "GitHub", "Docker", "AWS", "Azure", "TensorFlow", "PyTorch", "Machine Learning", "Deep Learning",
    "Artificial Intelligence", "Neural Networks", "Pandas", "NumPy", "Scikit-learn", "Matplotlib", "Data Science",
)

JOB_KEYWORDS = (
    "Python", "Django", "REST APIs", "SQL", "Git", "Java", "JavaScript", "React", "FastAPI", "Flask", "Machine Learning", "AWS", "Docker",
    "TensorFlow",
)

MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)

CONTACT_WORDS = ("phone", "mobile", "email", "linkedin", "github", "address")
