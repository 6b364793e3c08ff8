"""Reading container files and writing recovered documents."""
