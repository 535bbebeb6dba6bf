"""Codes, closed lists, headings and texts that results must carry unchanged."""

# Product status codes and the published-scope code with its default name.
LIVE = 9
DRAFT = 1
PUBLISHED_SCOPES = {"WEB": 1}
DEFAULT_SCOPE = "WEB"

# Fixed value: the attribute kind whose name is a list kept as JSON text.
LIST_KIND = 7

# Fixed value: rows of one page.
PAGE_SIZE = 10

# Export headings, in column order.
RECORD_HEADINGS = {
    "registration_no": "STD Reg No.",
    "student_name": "STD Name",
    "payment_name": "Payment Name",
    "teacher_name": "Teacher Name",
    "amount": "Fee Amount",
    "teacher_amount": "Teacher Share Amount(Rs)",
    "institute_amount": "Institute Share Amount(Rs)",
    "fixed_institute_amount": "Fixed Instiute Share Amount(Rs)",
    "month": "Month",
    "date": "Payment Date",
}
SUMMARY_HEADINGS = {
    "student_fee_amount": "Student Fee Amount",
    "total_teacher_amount": "Total Teacher Amount",
    "total_institute_amount": "Total Institute Share Amount",
    "total_fixed_institute_amount": "Total Fixed Institute Amount",
}
REVENUE_HEADING = (
    "Total Institute Revenue(Total Institute Amount + Total Fixed Institute Amount)"
)

# Schedule states and refusal texts.
COMPLETED = "completed"
CAPACITY_TEXT = "This %s with capacity %s Cannot Allocate %s Students"
TEACHER_TEXT = "This Teacher Has Another Lecture at this Schedule Slot"
MOVE_TEACHER_TEXT = "This teacher Has Another lecture at this schedule slot"
ROOM_TEXT = "This Schedule Time Slot Is Already Occupied"
COMPLETED_TEXT = "Cannot Update Completed Schedule"

# Message templates (line breaks of the original layout become single blanks).
CREATED_MESSAGE = (
    "A new lecture schedule was created for %s Room - %s. Date - %s. From - %s. To   - %s."
)
MOVED_MESSAGE = (
    "The %s lecture on %s, was updated to Room - %s. Date - %s. From - %s. To   - %s."
)

# Closed lists of a video request.
ALIGNMENTS = ["center", "left", "right", "none"]
STYLES = ["rectangular", "circular"]
BACKGROUNDS = [
    "off_white", "warm_white", "light_pink", "soft_pink", "light_blue", "dark_blue", "soft_cyan",
    "strong_cyan", "light_orange", "soft_orange", "white_studio", "white_cafe", "luxury_lobby",
    "large_window", "white_meeting_room", "open_office",
]
SHORT_MATCH_MODES = ["freeze", "loop", "slow_down"]
LONG_MATCH_MODES = ["trim", "speed_up"]

# Length limits and payload constants of a video request.
MAX_TITLE = 100
MAX_DESCRIPTION = 100
MAX_TRANSCRIPT = 1000
PAYLOAD_SCALE = 1.0
PAYLOAD_BACKGROUND_COLOR = "#F2F7FF"

# Own rule for the URL form: scheme http, https or ftp and a host with a dot.
URL_PATTERN = r"^(https?|ftp)://[^\s/?#]+\.[^\s]+$"
